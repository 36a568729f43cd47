"""Operator 3: secret scans with a randomness test battery. DataFrame functions only.

Fixed patterns give the base spans (kinds assign, access, hex). The method adds spans of kind ``random``. Runs of token
characters outside base spans are cut into tokens: for each encoding the longest stretches of its alphabet, so that a value
is also tested without the name, path or prefix it is glued to ('=' is padding at a run's end and a cut elsewhere). A token
is given the encoding its characters allow, and within its alphabet (ordered by how often ordinary text uses a symbol)
three tests are made:

* uniformity: chi-squared over the alphabet, its tail by the cube root of a gamma variable of the exact mean and variance
  (so it holds where symbols are expected far less than once);
* runs: neighbours that lie in different halves of the alphabet, an exact binomial count;
* serial correlation of neighbours, by its exact mean and small-sample variance.

Each test gives a p-value against randomness; Fisher's method combines the three (the two of order count as one) to
``p_random``. A token that the battery leaves as possibly random (``p_random`` at ``ALPHA`` or more) is a candidate. How far it stands from
ordinary text is a sum of normal scores of the same tests on what ordinary text does to an alphabet: uniformity over
character classes, over letters and over vowels; runs of character classes, and of vowels against consonants. Random tokens
score 0 on average, whatever their length; names made of words score 10 and more.

What ordinary tokens score is learnt from the corpus itself: in each encoding and length class the scores of all distinct
tokens that are judged are a mixture of random ones, whose distribution is known, and of ordinary ones, whose mean and
spread are fitted (``fitted_limit``). The tail of the fitted part is the p-value of Benjamini-Hochberg at ``RATE`` over those tokens.
Only a histogram of fixed size (``BINS`` rows a class) reaches the driver.

Spans are located, cut out and replaced in blocks of ``BLOCK``, so that a text with very many of them stays cheap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ACCESS_LENGTH, VALUE_LENGTH = 20, 6
KINDS = ("assign", "access", "hex", "random")
#: Any of them at the length that counts: what tokens are looked for outside of.
ANY_BASE = f"{ASSIGN[:-2]}{{{VALUE_LENGTH},}})|AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}|{HEX}"

#: Runs of so many characters are cut into tokens.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Letters in the order of their use in ordinary text.
_LOWER, _DIGITS = "etaoinshrdlcumwfgypbvkjxqz", "0123456789"
_UPPER = _LOWER.upper()
#: Encodings in the order they are tried: name, what the token must match, alphabet, and what names made of words score
#: in it, as a multiple of the root of their length (where the corpus has too few tokens to tell).
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef", 1.5),
    ("upper hex", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF", 1.5),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567", 1.65),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", _LOWER + _DIGITS + _UPPER, 2.2),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", _LOWER + _DIGITS + _UPPER + "+/", 2.2),
    ("base64url", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", _LOWER + _DIGITS + _UPPER + "-_", 2.2),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _LOWER + _DIGITS, 2.0),
)
#: What is cut out of a run: stretches of an encoding's alphabet, with the padding at the run's end.
STRETCHES = tuple(r"[" + c + r"]{20,}(?:=+$)?" for c in ("0-9a-f", "0-9A-F", "A-Z2-7", "A-Za-z0-9", "A-Za-z0-9+/", "A-Za-z0-9_-", "a-z0-9"))
ALPHA = 0.001
RATE = 0.05
#: Longest token whose runs are counted exactly; beyond it the binomial is normal to many digits.
EXACT = 256
BLOCK = 256
#: Length classes, by least length.
CLASSES = (20, 24, 32, 48, 96)
#: Scores are binned to a tenth, from -10 up to BINS / 10 - 10.
BINS = 700
#: The spread of ordinary scores where nothing else is known, and the spread of random ones (in hex alphabets, which have no vowels).
SPREAD, RANDOM_SPREAD, HEX_SPREAD = 2.6, 2.7, 2.0
#: What is known beforehand weighs like so many ordinary tokens; the fitted spread is widened by so much, since tails of names are not normal.
PRIOR, WIDER = 20.0, 1.15
_VOWEL, _CONSONANT = "aeiouy", "b-df-hj-np-tv-xz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: A rational fit of the complementary error function (relative error below 1.2e-7 everywhere).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _tail(x: Column) -> Column:
    """P(Z > x) of a normal variable."""

    def half(far: Column, t: Column) -> Column:
        series = F.lit(_ERFC[-1])
        for c in reversed(_ERFC[:-1]):
            series = t * series + c
        return t * F.exp(series - far * far) / 2

    upper = lambda far: _let(1 / (1 + far / 2), lambda t: half(far, t))
    return _let(x, lambda x: _let(_let(F.abs(x) / 2.0**0.5, upper), lambda p: F.when(x >= 0, p).otherwise(1 - p)))


def _gamma_z(x: Column, mean: Column, variance: Column) -> Column:
    """The normal score of ``x`` as a gamma variable (cube root)."""
    shape = mean * mean / variance
    return (F.cbrt(x / mean) - (1 - 1 / (9 * shape))) * 3 * F.sqrt(shape)


def _binomial(count: Column, n: Column, chance: float) -> Column:
    """(low, high): P(B <= count) and P(B >= count) of ``n`` trials, exact for ``n`` up to EXACT."""
    odds = chance / (1 - chance)

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"]
        return F.struct(
            (term * (n - j) / (j + 1) * odds).alias("term"),
            (acc["low"] + F.when(j <= count, term).otherwise(0.0)).alias("low"),
            (acc["high"] + F.when(j >= count, term).otherwise(0.0)).alias("high"),
        )

    start = F.struct(F.pow(F.lit(1 - chance), n).alias("term"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    exact = F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda a: F.struct(a["low"].alias("low"), a["high"].alias("high")))
    mean, width = n * chance, F.sqrt(n * (chance * (1 - chance)))
    return F.when(n <= EXACT, exact).otherwise(F.struct(_tail((mean - count - 0.5) / width).alias("low"), _tail((count - 0.5 - mean) / width).alias("high")))


def _fisher(uniformity: Column, runs: Column, serial: Column) -> Column:
    """The battery's p-values as one. Runs and serial correlation depend on one another: twice the lesser stands for both. With
    uniformity, which the order of symbols does not change, they are combined by Fisher's method; the tail of chi-squared with
    four degrees of freedom has a closed form."""
    y = -sum((F.ln(F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-100))) for x in (uniformity, 2 * F.least(runs, serial))), F.lit(0.0))
    return _let(y, lambda y: F.exp(-y) * (1 + y))


def _encoding(token: Column) -> Column:
    """(place, alphabet, shares of lower case, upper case, digits and others in it) of the token's encoding; null where it is
    ordinary letters or a mixture."""
    out = F.lit(None).cast("struct<place:int,alphabet:string,shares:array<double>>")
    for place, (_, pattern, alphabet, _) in reversed(list(enumerate(ENCODINGS))):
        kinds = [sum(map(f, alphabet)) for f in (str.islower, str.isupper, str.isdigit)]
        shares = F.array(*(F.lit(n / len(alphabet)) for n in (*kinds, len(alphabet) - sum(kinds))))
        out = F.when(token.rlike(pattern), F.struct(F.lit(place).alias("place"), F.lit(alphabet).alias("alphabet"), shares.alias("shares"))).otherwise(out)
    return out


def _score(token: Column, encoding: Column) -> Column:
    """How far a token stands from random symbols towards ordinary text; the sum of three scores in hex alphabets, of five in others."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    n, shares, hexadecimal = F.char_length(token).cast("double"), encoding["shares"], encoding["place"] < 2
    seen = F.array(*(count(token, c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]")))
    cells = F.filter(F.zip_with(seen, shares, lambda x, p: F.struct(x.alias("x"), p.alias("p"))), lambda c: c["p"] > 0)
    classes = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.pow(c["x"] - n * c["p"], 2) / (n * c["p"]))
    freedom = F.size(cells).cast("double") - 1

    letters = F.when(hexadecimal, F.lower(token)).otherwise(F.lower(F.regexp_replace(token, "[^A-Za-z]", "")))
    symbols = F.split(F.when(hexadecimal, F.lit(_DIGITS + "abcdef")).otherwise(F.lit(_LOWER)), "")
    k = F.size(symbols).cast("double")
    even = lambda m, s: F.when(m > 1, _gamma_z(k * s / m - m, k - 1, 2 * (k - 1) * (m - 1) / m)).otherwise(0.0)
    squares = lambda text: F.aggregate(F.transform(symbols, lambda c: F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))), F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    alike = F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * p)
    binomial = lambda x, trials, chance: F.when(trials > 0, (x - trials * chance) / F.sqrt(trials * chance * (1 - chance))).otherwise(0.0)
    turns = count(token, "[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[+/_-](?=[^+/_-])")
    vowels = len(_VOWEL) / 26

    def spoken(text: Column) -> Column:
        pairs = count(token, "[A-Za-z](?=[A-Za-z])")
        swaps = count(token, f"(?i)[{_VOWEL}](?=[{_CONSONANT}])|[{_CONSONANT}](?=[{_VOWEL}])")
        return binomial(count(text, f"[{_VOWEL}]"), F.char_length(text).cast("double"), F.lit(vowels)) + binomial(swaps, pairs, F.lit(2 * vowels * (1 - vowels)))

    return _gamma_z(classes, freedom, 2 * freedom) - binomial(turns, n - 1, 1 - alike) + _let(letters, lambda t: even(F.char_length(t).cast("double"), squares(t)) + F.when(hexadecimal, 0.0).otherwise(spoken(t)))


def _tests(token: Column, encoding: Column) -> Column:
    """(p_random, score, place) of a token in its encoding."""
    alphabet = encoding["alphabet"]
    n, k = F.char_length(token).cast("double"), F.char_length(alphabet).cast("double")
    letters = F.split(alphabet, "")
    squares = F.aggregate(F.transform(letters, lambda c: F.char_length(token) - F.char_length(F.replace(token, c, F.lit("")))), F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    codes = F.transform(F.split(token, ""), lambda c: F.position(c, alphabet).cast("double") - 1)

    def judged(s: Column, v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) - n * mean * mean
        pairs = F.zip_with(F.slice(v, F.lit(1), (n - 1).cast("int")), F.slice(v, F.lit(2), (n - 1).cast("int")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        together = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["x"] - mean) * (p["y"] - mean))
        changes = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when((2 * p["x"] >= k) != (2 * p["y"] >= k), 1.0).otherwise(0.0))
        correlation = F.when(spread > 0, together / spread).otherwise(F.lit(1.0))
        return _let(F.struct(changes.alias("changes"), correlation.alias("r")), lambda m: combined(s, m["changes"], m["r"]))

    def combined(s: Column, changes: Column, r: Column) -> Column:
        width = (n - 2) / (n * F.sqrt(n - 1))
        # symbols in more even shares than chance gives (alphabets written out, counters) are not random either
        uniform = _let(_tail(_gamma_z(k * s / n - n, k - 1, 2 * (k - 1) * (n - 1) / n)), lambda p: F.when(1 - p < ALPHA, 1 - p).otherwise(p))
        even = _binomial(changes, n - 1, 0.5)
        serial = 2 * _tail(F.abs(r + 1 / n) / width)
        return F.struct(_fisher(uniform, _let(even, lambda e: 2 * F.least(e["low"], e["high"])), serial).alias("p_random"), _score(token, encoding).alias("score"), encoding["place"].alias("place"))

    return _let(squares, lambda s: _let(codes, lambda v: judged(s, v)))


def _tested(token: Column) -> Column:
    """(p_random, score, place) of a token, null where it has no encoding; padding at the end does not count."""
    return _let(F.rtrim(token, F.lit("=")), lambda t: _let(_encoding(t), lambda e: F.when(e.isNotNull() & (F.char_length(t) >= CLASSES[0]), _tests(t, e))))


def _class(length: Column) -> Column:
    out = F.lit(CLASSES[0])
    for least in CLASSES[1:]:
        out = F.when(length >= least, least).otherwise(out)
    return out


def _bin(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(10 * (score + 10)))).cast("int")


def fitted_limit(bins: dict[int, int], candidates: dict[int, int], mean: float, random: float, rate: float = RATE) -> int | None:
    """The greatest bin whose candidates Benjamini-Hochberg reports, None if it reports none.

    ``bins`` counts all judged tokens by score, ``candidates`` those that may be random; ``mean`` is what ordinary tokens are expected
    to score, ``random`` the spread of random ones (about 0). Ordinary scores are taken as normal; their mean and spread are
    fitted by expectation maximisation, with PRIOR tokens of the expected kind added. Tokens beyond their mean are ordinary
    however far they lie.
    """
    if not bins:
        return None
    known = mean + SPREAD * np.linspace(-2.5, 2.5, 21)
    weight = np.exp(-(((known - mean) / SPREAD) ** 2) / 2)
    places = sorted(bins)
    score, count = np.array(places) / 10 - 9.95, np.array([bins[b] for b in places], np.float64)
    x, c = np.concatenate([score, known]), np.concatenate([count, PRIOR * weight / weight.sum()])
    seen = np.arange(len(x)) < len(score)
    centre, spread, share = mean, SPREAD, 0.5
    for _ in range(200):
        drawn = share * np.exp(-((x / random) ** 2) / 2) / random
        plain = (1 - share) * np.exp(-(((x - centre) / spread) ** 2) / 2) / spread
        ordinary = np.where(seen, plain / np.maximum(drawn + plain, 1e-300), 1.0)
        ordinary = np.where(seen & (x < -2 * random), 0.0, np.where(x > centre, 1.0, ordinary)) * c
        centre = (ordinary * x).sum() / ordinary.sum()
        spread = max(1.5, float(np.sqrt((ordinary * (x - centre) ** 2).sum() / ordinary.sum())))
        share = float(np.clip(1 - ordinary[seen].sum() / count.sum(), 1e-6, 1 - 1e-6))
    limit, rank = None, 0
    for b, s in zip(places, score, strict=True):
        rank += candidates.get(b, 0)
        tail = math.erfc((centre - s) / (WIDER * spread) / math.sqrt(2)) / 2
        if candidates.get(b, 0) and tail * count.sum() <= rate * rank:
            limit = b
    return limit


def thresholds(docs: DataFrame, text_col: str = "text") -> dict[tuple[int, int], int]:
    """For each encoding (its place) and length class the greatest bin of scores that is reported, over all distinct tokens that
    ``with_spans`` judges in all texts."""
    judged = _judged(docs.select(F.col(f"`{text_col}`").alias("text")), "text").select(F.explode("__runs").alias("run"))
    tokens = judged.select(F.explode(_tokens(F.col("run"))["token"]).alias("token")).distinct()
    tested = tokens.select(_class(F.char_length(F.rtrim("token", F.lit("=")))).alias("least"), _tested(F.col("token")).alias("t")).where("t is not null")
    counts = tested.groupBy("t.place", "least", _bin(F.col("t.score")).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("t.p_random") >= ALPHA).alias("candidates")).collect()
    out = {}
    for place, least in {(r["place"], r["least"]) for r in counts}:
        own = [r for r in counts if (r["place"], r["least"]) == (place, least)]
        ends = dict(zip(CLASSES, (*CLASSES[1:], 2 * CLASSES[-1]), strict=True))
        mean = ENCODINGS[place][3] * math.sqrt((least + ends[least]) / 2)
        limit = fitted_limit({r["bin"]: r["n"] for r in own}, {r["bin"]: r["candidates"] for r in own if r["candidates"]}, mean, HEX_SPREAD if place < 2 else RANDOM_SPREAD)
        if limit is not None:
            out[place, least] = limit
    return out


def _judged(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__runs``, the runs of token characters outside base spans, and ``__rest``, the text with base spans blanked."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blanks = F.zip_with(F.split(text, ANY_BASE), F.concat(F.regexp_extract_all(text, F.lit(ANY_BASE), F.lit(0)), F.array(F.lit(""))), lambda gap, m: F.concat(gap, F.repeat(F.lit(" "), F.char_length(m))))
    out = docs.withColumn("__rest", F.when(text.rlike(ANY_BASE), F.array_join(blanks, "")).otherwise(text))
    return out.withColumn("__runs", F.regexp_extract_all("__rest", F.lit(TOKEN), F.lit(0)))


def _blocks(array: Column) -> Column:
    """An array in parts of BLOCK elements; no part of an empty one."""
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(array), 1, 0))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _located(found: Column, gaps: Column, keep: Callable[[Column], Column], kind: int) -> Column:
    """(start, kind, end) in code points of the matches that ``keep``, from the matches and the texts between them."""
    empty = F.array().cast(_SPANS)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), keep(m).alias("keep")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def placed(made: Column) -> Column:
        begins = F.aggregate(made, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, m: F.struct((a["at"] + m["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(made, begins, lambda m, b: F.transform(m["spans"], lambda s: F.struct((s["start"] + b).alias("start"), s["kind"].alias("kind"), (s["end"] + b).alias("end")))))

    each = _let(sizes, lambda x: F.transform(_blocks(x), lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)))
    return F.when(F.size(found) > 0, _let(each, placed)).otherwise(empty)


def _cut_out(text: Column, spans: Column) -> Column:
    """The texts of spans in order of their start."""

    def block(part: Column) -> Column:
        base = part[0]["start"]
        held = F.substring(text, base + 1, F.array_max(F.transform(part, lambda s: s["end"])) - base)
        return _let(held, lambda h: F.transform(part, lambda s: F.substring(h, s["start"] - base + 1, s["end"] - s["start"])))

    return F.flatten(F.transform(_blocks(spans), block))


def _tokens(run: Column) -> Column:
    """(start, kind, end, token) of the tokens of a run, each place once; they may overlap."""

    def one(p: Column) -> Column:
        placed = lambda found: F.zip_with(_located(found, F.split(run, p), lambda m: F.lit(True), 3), found, lambda s, m: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), m.alias("token")))
        return _let(F.regexp_extract_all(run, p, F.lit(0)), placed)

    return F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, STRETCHES)), one)))


def _united(spans: Column) -> Column:
    """Spans in order of their start, those that overlap as one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), s["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] > s["start"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def with_spans(docs: DataFrame, text_col: str = "text", bins: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """``docs`` with ``__spans``: array of (start, kind, end), kind the place in ``KINDS``, in order of start and kind.

    Base spans are leftmost and do not overlap within a kind; random spans are those tokens outside of base spans that pass
    the battery, tokens that overlap as one span. Null texts have none. ``bins`` are the limits by encoding and length
    class (by default those of ``docs``).
    """
    bins = thresholds(docs, text_col) if bins is None else bins
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def random(token: Column) -> Column:
        least = _class(F.char_length(F.rtrim(token, F.lit("="))))

        def limit(place: Column) -> Column:
            out = F.lit(None).cast("int")
            for (p, c), b in bins.items():
                out = F.when((place == p) & (least == c), b).otherwise(out)
            return out

        return F.coalesce(_let(_tested(token), lambda t: (t["p_random"] >= ALPHA) & (_bin(t["score"]) <= limit(t["place"]))), F.lit(False))

    kinds = (
        (ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= VALUE_LENGTH),
        (ACCESS, lambda m: F.char_length(m) >= ACCESS_LENGTH),
        (HEX, lambda m: F.lit(True)),
    )
    none = F.array().cast(_SPANS)
    out = docs.withColumns({f"__found{i}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for i, (p, _) in enumerate(kinds)})
    spans = [F.when(F.size(f"__found{i}") > 0, _located(F.col(f"__found{i}"), F.split(text, p), keep, i)) for i, (p, keep) in enumerate(kinds)]
    out = out.withColumn("__base", F.array_sort(F.concat(*(F.coalesce(x, none) for x in spans))))
    out = _judged(out, text_col)
    places = _located(F.col("__runs"), F.split("__rest", TOKEN), lambda m: F.lit(True), 3)
    shifted = lambda run, s: F.struct((run["start"] + s["start"]).alias("start"), s["kind"].alias("kind"), (run["start"] + s["end"]).alias("end"))
    added = F.flatten(F.zip_with(places, "__runs", lambda run, body: _united(F.transform(F.filter(_tokens(body), lambda s: random(s["token"])), lambda s: shifted(run, s)))))
    out = out.withColumn("__spans", F.when(F.size("__runs") > 0, F.array_sort(F.concat("__base", added))).otherwise(F.col("__base")))
    return out.drop(*(f"__found{i}" for i in range(3)), "__base", "__rest", "__runs")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, found) for each row of ``docs``.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind; base_sha256 digests the base spans
    written so; ``found`` holds the secrets themselves. Null and empty texts have no spans; repeated rows are judged
    each; other columns are ignored; an empty table gives no rows.
    """
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    name = F.array(*(F.lit(k) for k in KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(written(F.filter("__spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("__spans")).alias("spans"),
        _cut_out(F.col("text"), F.col("__spans")).alias("found"),
    )


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mark`` (overlapping spans by one); other columns as they are.

    A text without secrets, null or empty stays as it is.
    """
    rows = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text_col}`").alias("text")))
    text = F.col("text")

    def block(acc: Column, part: Column) -> Column:
        """A block of spans: the text from where the last one ended, with a mark for each span that begins beyond the others."""
        base = acc["at"]
        ends = F.array_max(F.transform(part, lambda s: s["end"]))

        def step(held: Column):
            def one(a: Column, s: Column) -> Column:
                piece = F.concat(F.substring(held, a["at"] - base + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.lit(mark))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(piece))).otherwise(a["parts"]).alias("parts"))

            return one

        start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("parts"))
        done = _let(F.substring(text, base + 1, F.greatest(F.lit(0), ends - base)), lambda held: F.aggregate(part, start, step(held)))
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], F.array(F.array_join(d["parts"], ""))).alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(_blocks(F.col("__spans")), start, block, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    new = F.when(F.size("__spans") > 0, clean).otherwise(text)
    return rows.select(*((new if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns))
