"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests takes for keys.

Only DataFrame functions.  Patterns are matched leftmost and without overlap; positions are code points.

Candidates of the battery are runs of at least ``SHORTEST`` characters that keys are written with.  Each gets the
narrowest encoding it fits (hex, base32, base36 of either case, base62, base64) and, for the hypothesis that its characters are independent and
uniform over that alphabet, three p-values: chi-squared of the character counts (Wilson and Hilferty's
approximation), runs below and above the middle of the alphabet (Wald and Wolfowitz), and correlation of neighbours.
Fisher's method combines them; a candidate whose p is at most ``FIT`` is not uniform.

Each candidate is also weighed against the hypothesis of structured text (words, names, paths, numbers): a chain over
characters with fixed costs.  Its gain is the logarithm of the likelihood ratio, uniform to structured, and does not depend on
other candidates.  The share of random ones is the most likely one given the gains of an encoding's candidates of all lengths in
the table, 1/2 at most; a candidate counts if it is then random with probability 1 - ``FALSE_SHARE``.  So a single key
is found on its own, many words only raise the gain that is asked for, and no find is free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, group that is measured, fewest characters of it.  Runs of one character class need no later test of
#: their length; an assignment does, as a short value uses up its text.
ASSIGN = (
    "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
KINDS = (("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))
RANDOM = "random"
SHORTEST = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding, what a string in it looks like, alphabet; the first that fits is taken
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", LOWER + DIGITS),
    ("BASE36", "^[A-Z0-9]+$", UPPER + DIGITS),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),
)
FIT = 0.001
FALSE_SHARE = 0.05
LEAST_P = 1e-12

#: Costs of structured text, -ln of a probability.  Fixed values: of a letter alone and after another one (rows a to z) in
#: halves, one hexadecimal digit each, from English and seven other European languages; of the first character's class, and of a
#: class after another one (lower case, upper case, digit, sign) in tenths.
LETTERS = "597749875b967558d56579ab9a"
PAIRS = (
    "8766da7b7a8464c7c454889b99 499b3ccc46f4ab5cf5895fcf7d 4f8c5ff35967dd3cf7a57fffb8 4ba82dbc4cc9b84af77a6cceaa "
    "7966888a7b9674b8b34599a7ba 5cba56be2ff6dc3cf6876fefaf 5aca2e784fc7a65af5684dcfdd 4eed2ffc4fe7a95ef7b67fcfcf "
    "6857587ec9866358b755b7cae9 3cb72aac5d79a65afb6959bfd9 3b9c3da94e97c84af6656c9fcd 4ac738aa3ca5b95afc766bcf8e "
    "36db3ddf4fda6955fc9a7ddfbf 5c64485a5d9ac85bec6478df8a b7669a8d9c965386d456687cdb 3e9a4bba6fb5cb46f4866bef9c "
    "8dcb9edd9febcaadd9aa0e9fef 4a873a7c4e9a775bd76679af88 6c6c3bb75c78aa66cb536bbf89 4dac3bd44fb9bb5af5776daf8b "
    "6778588e6a9554a6f454daabcb 3cdd2ddf4ffccb4df9acacffef 3dba4dc63fb9d75bf77c9fbe5b 5a5a59da4fb99b84faa2aec88f "
    "5859789d78775674f8548d7fbc 39aa3fba4bab866adbb96f7f58"
).split()
FIRST = (5, 16, 19, 30)
NEXT = ((1, 35, 35, 28), (8, 9, 30, 25), (23, 32, 3, 23), (4, 19, 17, 39))
SIGNS = UPPER + LOWER + DIGITS + "+/"  # characters of structured text
SPAN = 60  # gains beyond it, up or down, are equal to it when the share is estimated

PLACEHOLDER = "<secret>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, body, part>> of a pattern's matches: positions, the match and one of its groups."""
    regex = F.lit(pattern)
    bodies = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.regexp_extract_all(text, regex, F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    joined = F.zip_with(gaps, bodies, lambda g, b: F.struct(g.alias("gap"), b.alias("body")))
    rows = F.zip_with(joined, parts, lambda r, p: F.struct(r["gap"].alias("gap"), r["body"].alias("body"), p.alias("part")))
    nothing = F.array().cast("array<struct<start:int,end:int,body:string,part:string>>")

    def take(done: Column, row: Column) -> Column:
        start = done["at"] + row["gap"]
        end = start + F.length(row["body"])
        item = F.struct(start.alias("start"), end.alias("end"), row["body"].alias("body"), row["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(item)).alias("found"))

    rows = F.slice(rows, 1, F.size(bodies))  # the last gap has no match after it
    folded = F.aggregate(rows, F.struct(F.lit(0).alias("at"), nothing.alias("found")), take, lambda done: done["found"])
    return F.when(F.size(bodies) > 0, folded).otherwise(nothing)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution; Abramowitz and Stegun 26.2.17 (fixed coefficients)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-x * x / 2) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _fields(item: Column, *names: str) -> list[Column]:
    return [item[n].alias(n) for n in names]


def _by_encoding(item: Column, value) -> Column:
    found = F.lit(value(ENCODINGS[-1]))
    for encoding in reversed(ENCODINGS[:-1]):
        found = F.when(item["encoding"] == encoding[0], F.lit(value(encoding))).otherwise(found)
    return found


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _cost(before: str, c: str) -> int:
    """Tenths that ``c`` costs after ``before``, or as the first character; an upper-case letter after a lower one begins a word."""
    was, kind = _kind(before) if before else 3, _kind(c)
    turn = NEXT[was][kind] if before else FIRST[kind]
    if kind > 1:
        return turn + (23 if kind == 2 else 14)
    at = ord(c.lower()) - ord("a")
    alone = was > 1 or was < kind
    return turn + 5 * int(LETTERS[at] if alone else PAIRS[ord(before.lower()) - ord("a")][at], 16)


def _costs(befores) -> Column:
    """Array of the costs of each of SIGNS after each of ``befores``."""
    return F.split(F.lit(",".join(str(_cost(b, c)) for b in befores for c in SIGNS)), ",").cast("array<int>")


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with random, array<struct<start, end, encoding, gain, p>>."""
    place = ("start", "end", "encoding")
    kept = (*place, "gain")
    first, following = _costs([""]), _costs(SIGNS)

    def encoded(item: Column) -> Column:
        body = F.regexp_replace(item["body"], "=+$", "")
        encoding = F.lit(ENCODINGS[-1][0])
        for name, looks, _ in reversed(ENCODINGS[:-1]):
            encoding = F.when(body.rlike(looks), F.lit(name)).otherwise(encoding)
        return F.struct(item["start"].alias("start"), item["end"].alias("end"), encoding.alias("encoding"), body.alias("body"))

    def spelled(item: Column) -> Column:
        hexed = F.when(item["encoding"] == "hex", F.lower(item["body"])).otherwise(F.translate(item["body"], "-_", "+/"))
        alphabet = _by_encoding(item, lambda e: e[2])
        return F.struct(*_fields(item, *place), hexed.alias("body"), alphabet.alias("alphabet"),
                        F.length(item["body"]).alias("n"), F.length(alphabet).alias("k"))

    def placed(item: Column) -> Column:
        plain = F.when(item["body"].rlike("[a-z]"), item["body"]).otherwise(F.lower(item["body"]))  # one case is no sign
        at = F.transform(F.split(plain, "", item["n"]), lambda c: F.position(c, F.lit(SIGNS)))
        return F.struct(*_fields(item, *place, "body", "alphabet", "n", "k"), at.alias("at"))

    def weighed(item: Column) -> Column:
        at, n = item["at"], item["n"]
        steps = F.zip_with(
            F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda a, b: F.element_at(following, len(SIGNS) * (a - 1) + b)
        )
        cost = F.aggregate(steps, F.element_at(first, F.element_at(at, 1)), lambda total, x: total + x)
        gain = cost / 10 - n * F.log(item["k"].cast("double"))
        return F.struct(*_fields(item, *place, "body", "alphabet", "n", "k"), gain.alias("gain"))

    def counted(item: Column) -> Column:
        letters = F.split(item["body"], "", item["n"])
        codes = F.transform(letters, lambda c: F.position(c, item["alphabet"]) - 1)
        held = F.aggregate(
            F.split(item["alphabet"], "", item["k"]), F.lit(0).cast("long"),
            lambda total, c: total + F.pow(item["n"] - F.length(F.replace(item["body"], c, F.lit(""))), 2).cast("long"),
        )
        return F.struct(*_fields(item, *kept, "n", "k"), codes.alias("codes"), held.alias("squares"))

    def summed(item: Column) -> Column:
        codes, n = item["codes"], item["n"]
        half = item["k"] / 2
        high = F.size(F.filter(codes, lambda x: x >= half))
        nothing = F.lit(0).cast("long")
        ahead, behind = F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1)
        pairs = F.zip_with(ahead, behind, lambda a, b: (a * b).cast("long"))
        turns = F.zip_with(ahead, behind, lambda a, b: F.when((a >= half) != (b >= half), 1).otherwise(0))
        add = lambda total, x: total + x
        return F.struct(
            *_fields(item, *kept, "n", "k", "squares"), high.alias("high"),
            (F.aggregate(turns, nothing, add) + 1).alias("runs"), F.aggregate(codes, nothing, add).alias("sum"),
            F.aggregate(F.transform(codes, lambda x: x * x), nothing, add).alias("sum2"),
            F.aggregate(pairs, nothing, add).alias("products"),
            (F.element_at(codes, 1) + F.element_at(codes, -1)).alias("ends"),
        )

    def normal_scores(item: Column) -> Column:
        n, k = item["n"].cast("double"), item["k"].cast("double")
        chi = k / n * item["squares"] - n
        spread = 2 / (9 * (k - 1))
        z1 = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        both = 2.0 * item["high"] * (n - item["high"])
        variance = both * (both - n) / (n * n * (n - 1))
        z2 = F.when(variance > 0, F.abs(item["runs"] - both / n - 1) / F.sqrt(variance))
        mean = item["sum"] / n
        square = item["sum2"] - n * mean * mean
        cross = item["products"] - mean * (2 * item["sum"] - item["ends"]) + (n - 1) * mean * mean
        z3 = F.when(square > 0, F.abs(cross / square * F.sqrt(n) + 1 / F.sqrt(n)))
        return F.struct(*_fields(item, *kept), z1.alias("z1"), z2.alias("z2"), z3.alias("z3"))

    def tails(item: Column) -> Column:
        # without spread a test cannot be made: such a string is not random
        p = (_tail(item["z1"]), F.coalesce(2 * _tail(item["z2"]), F.lit(LEAST_P)), F.coalesce(2 * _tail(item["z3"]), F.lit(LEAST_P)))
        names = ("p1", "p2", "p3")
        return F.struct(*_fields(item, *kept), *[x.alias(name) for x, name in zip(p, names)])

    def summed_logs(item: Column) -> Column:
        logs = [F.log(F.least(F.greatest(item[x], F.lit(LEAST_P)), F.lit(1.0))) for x in ("p1", "p2", "p3")]
        return F.struct(*_fields(item, *kept), (-(logs[0] + logs[1] + logs[2])).alias("s"))

    def combined(item: Column) -> Column:
        s = item["s"]
        return F.struct(*_fields(item, *kept), (F.exp(-s) * (1 + s + s * s / 2)).alias("p"))

    docs = docs.withColumn("random", F.transform(matches(text, CANDIDATE), encoded))
    for step in (spelled, placed, weighed, counted, summed, normal_scores, tails, summed_logs, combined):
        docs = docs.withColumn("random", F.transform("random", step))
    return docs


def _share(weights: list[tuple[float, int]], unfit: int) -> float:
    """Most likely share of random ones among candidates with these gains and counts, and others that cannot be random.

    From that of half a candidate to 1/2: the likelihood has one peak, which is searched by its slope.
    """
    low, high = 0.5 / (unfit + sum(n for _, n in weights)), 0.5
    ratios = [(math.exp(gain) - 1, n) for gain, n in weights]
    for _ in range(60):
        mid = math.sqrt(low * high)
        slope = sum(n * r / (1 + mid * r) for r, n in ratios) - unfit / (1 - mid)
        low, high = (mid, high) if slope > 0 else (low, mid)
    return low


def least_gains(found: DataFrame) -> dict[str, float]:
    """The gain from which a candidate of an encoding counts."""
    gain = F.floor(F.greatest(F.least("x.gain", F.lit(float(SPAN))), F.lit(-float(SPAN)))).cast("int")
    items = found.select(F.explode("random").alias("x")).select("x.encoding", gain.alias("gain"), (F.col("x.p") > FIT).alias("fits"))
    rows = items.groupBy("encoding", "gain", "fits").agg(F.count(F.lit(1)).alias("n")).collect()
    chosen = {}
    for encoding in {r["encoding"] for r in rows}:
        own = [r for r in rows if r["encoding"] == encoding]
        share = _share([(r["gain"], r["n"]) for r in own if r["fits"]], sum(r["n"] for r in own if not r["fits"]))
        chosen[encoding] = math.log((1 - FALSE_SHARE) / FALSE_SHARE) - math.log(share / (1 - share))
    return chosen


def _at_least(n: int):
    return lambda match: F.length(match["part"]) >= n


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with spans, array<struct<start, end, kind>> by start, then kind in the order of KINDS, random last.

    A candidate that overlaps a pattern's match is left to the pattern.  A null or empty text has no spans.  All rows and
    columns stay; a column named spans is replaced.  An empty table gives an empty result.
    """
    text = F.col("_text")
    own = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    chosen = least_gains(candidates(own.select("_text"), text))
    found = own
    for kind, pattern, group, least in KINDS:
        found = found.withColumn(f"_{kind}", F.filter(matches(text, pattern, group), _at_least(least)))
    found = candidates(found, text)
    names = [k[0] for k in KINDS]

    def spans(kind: str, at: str, rank: int) -> Column:
        return F.transform(at, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*[spans(kind, f"_{kind}", i) for i, kind in enumerate(names)])
    bar = F.lit(None).cast("double")

    def counts(m: Column) -> Column:
        limit = bar
        for encoding, least in chosen.items():
            limit = F.when(m["encoding"] == encoding, F.lit(least)).otherwise(limit)
        clear = ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        return F.coalesce((m["p"] > FIT) & (m["gain"] >= limit), F.lit(False)) & clear

    found = found.withColumn("_base", base).withColumn("_random", F.filter("random", counts))
    both = F.array_sort(F.concat(F.col("_base"), spans(RANDOM, "_random", len(names))))
    kept = F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.withColumn("spans", kept).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "spans"], "spans")


def redact(docs: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with each secret of text replaced by ``placeholder``; overlapping ones become one.  Null texts stay null."""
    text = F.col("text")

    def step(done: Column, s: Column) -> Column:
        apart = s["start"] >= done["at"]
        between = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        out = F.when(apart, F.concat(done["out"], between, F.lit(placeholder))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("spans", start, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    own = docs.select(F.struct("*").alias("_row"), "text")
    found = find_secrets(own).withColumn("text", F.when(F.size("spans") > 0, rest).otherwise(text))
    return found.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
