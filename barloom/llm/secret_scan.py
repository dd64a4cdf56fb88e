"""Secrets in texts: three fixed patterns, and strings that pass a battery of randomness tests.

Built-in functions only. Positions come from cutting a text at a pattern: the lengths of pieces and
matches, summed up.

The battery looks at every run of 20 or more characters of the base64 alphabets. Its encoding
is the first alphabet that holds all its characters. Under that alphabet three tests ask whether it could be
uniformly random: chi-squared over the symbols, runs above and below the alphabet's middle, and the
correlation of neighbouring symbols. Fisher's method joins their p-values; what they reject is out.

What is left may still be an ordinary word that is too short to be told from a random one. So each
string also gets the probability that ordinary text of its length repeats its symbols as rarely:
the number of equal pairs of symbols (of which chi-squared is a linear function) has, under the symbol
frequencies of the whole corpus, a mean and a variance that depend on the length. On these
probabilities the Benjamini-Hochberg rule keeps the share of false discoveries at `FALSE_SHARE`, in
each class of lengths apart, so that the many short strings don't drown the long ones.
A string counts once for the rule, however often it occurs.

Two passes read the texts: one for the symbol frequencies, one for spans and tests. The rest reads
the spans, which are written to the shared folder. A few hundred counts reach the driver.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import staged

# Fixed values of the definition: kinds in their order, patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 6, 20

SHORTEST = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
#: Candidates that the patterns report already.
KNOWN = r"\A(?:[0-9a-f]{24,}|AKIA[A-Z0-9]{16,})\z"
LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Alphabets in the order in which they are tried; symbols are numbered as listed.
ENCODINGS = (
    DIGITS,
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    UPPER + "234567",
    LOWER,
    LOWER + DIGITS,
    UPPER + DIGITS,
    UPPER + LOWER + DIGITS,
    UPPER + LOWER + DIGITS + "+/",
    UPPER + LOWER + DIGITS + "-_",
    UPPER + LOWER + DIGITS + "+/-_",
)
#: Random strings that the battery rejects, and ordinary ones among those reported.
REJECTED_SHARE, FALSE_SHARE = 0.001, 0.01
#: Probabilities are counted by their decimal logarithm, in steps of 1 / STEPS, down to 10 ** -DECADES.
STEPS, DECADES = 20, 40


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(lengths: Column) -> Column:
    """The sums of all elements before each one; in chunks, so that long arrays aren't copied for each element."""

    def sums(values: Column) -> Column:
        return F.aggregate(
            values, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, F.lit(-1)) + x))
        )

    width = 256
    chunks = F.transform(F.sequence(F.lit(0), F.size(lengths), F.lit(width)), lambda i: F.slice(lengths, i + 1, F.lit(width)))
    heads = sums(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)))
    inner = F.zip_with(chunks, F.slice(heads, F.lit(1), F.size(chunks)), lambda c, head: F.transform(F.slice(sums(c), F.lit(1), F.size(c)), lambda s: s + head))
    return F.flatten(inner)


def matches(text: Column, pattern: str) -> Column:
    """start, end (exclusive, in code points) and hit of all leftmost matches, which must not be empty."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(hits: Column) -> Column:
        gaps = F.transform(pieces, lambda piece: F.length(piece))
        sizes = F.transform(hits, lambda hit: F.length(hit))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), sizes, lambda gap, size: gap + size)
        return _let(_running(steps), lambda before: F.zip_with(
            F.zip_with(before, gaps, lambda start, gap: start + gap), hits,
            lambda start, hit: F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit")),
        ))

    def whole(found: Column) -> Column:
        return F.filter(found, lambda m: m["hit"].isNotNull())

    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(text.rlike(pattern), whole(_let(hits, placed))).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The spans of the three patterns as (start, kind, end), in order."""

    def spans(kind: int, pattern: str, keep=None) -> Column:
        found = matches(text, pattern)
        if keep is not None:
            found = F.filter(found, keep)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.array_sort(
        F.concat(
            spans(0, ASSIGN, lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= LEAST_VALUE),
            spans(1, ACCESS, lambda m: F.length(m["hit"]) >= LEAST_ACCESS),
            spans(2, HEX),
        )
    )


# --- the battery -----------------------------------------------------------------------------------


def upper_tail(z: Column) -> Column:
    """The probability that a standard normal exceeds z (Abramowitz and Stegun 26.2.17)."""

    def of_positive(x: Column) -> Column:
        def series(t: Column) -> Column:
            # The coefficients of the approximation.
            out = F.lit(1.330274429)
            for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
                out = out * t + c
            return out * t

        return F.exp(-x * x / 2) * 0.3989422804014327 * _let(1 / (1 + 0.2316419 * x), series)

    return _let(z.cast("double"), lambda v: F.when(v >= 0, of_positive(v)).otherwise(1 - of_positive(-v)))


def symbol_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each symbol of the alphabets occurs in ordinary runs of all texts, those too short to be candidates: 66 counts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9+/_-]+"), F.lit(0))).alias("w"))
    distinct = words.where(F.length("w") < SHORTEST).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    symbols = distinct.select(F.explode(F.split("w", "")).alias("c"), "n").where("c <> ''")
    return {r.c: r.n for r in symbols.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def coincidence(counts: dict[str, int]) -> list[tuple[float, float]]:
    """For each encoding, the sums of squares and of cubes of ordinary symbol frequencies.

    In an alphabet of one case, letters count as they occur in either.
    """
    out = []
    for alphabet in ENCODINGS:
        one_case = not (set(LOWER[6:]) <= set(alphabet) and set(UPPER[6:]) <= set(alphabet))
        weights = [
            1 + (counts.get(c.lower(), 0) + counts.get(c.upper(), 0) if one_case and c.isalpha() else counts.get(c, 0)) for c in alphabet
        ]
        total = sum(weights)
        out.append((sum((w / total) ** 2 for w in weights), sum((w / total) ** 3 for w in weights)))
    return out


def _pick(values: list, encoding: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), encoding)


def tested(hit: Column, ordinary: list[tuple[float, float]]) -> Column:
    """size, p_random (of the battery) and p_ordinary of one candidate."""
    core = F.rtrim(hit, F.lit("="))
    encoding = F.lit(len(ENCODINGS))
    for number in range(len(ENCODINGS) - 1, 0, -1):
        encoding = F.when(F.translate(core, ENCODINGS[number - 1], "") == "", F.lit(number)).otherwise(encoding)

    def normal(count: Column, mean: Column, variance: Column) -> Column:
        return (count - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))

    def equal_pairs(core: Column, chars: Column) -> Column:
        def pairs(c: Column) -> Column:
            n = (F.length(core) - F.length(F.replace(core, c, F.lit("")))).cast("double")
            return n * (n - 1) / 2

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + pairs(c))

    def moments(n: Column, s2: Column, s3: Column) -> tuple[Column, Column]:
        """Mean and variance of the number of equal pairs among n independent symbols."""
        all_pairs = n * (n - 1) / 2
        return all_pairs * s2, all_pairs * s2 * (1 - s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)

    def neighbours(values: Column, n: Column, use) -> Column:
        pairs = F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), use)
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)

    def two_sided(z: Column) -> Column:
        return 2 * upper_tail(F.abs(z))

    def runs_test(values: Column, n: Column, k: Column) -> Column:
        above = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v * 2 >= k).cast("double"))
        changes = neighbours(values, n, lambda a, b: ((a * 2 >= k) != (b * 2 >= k)).cast("double"))

        def score(n1: Column) -> Column:
            both = 2 * n1 * (n - n1)
            return F.when(both == 0, F.lit(0.0)).otherwise(
                two_sided(normal(changes + 1, 1 + both / n, both * (both - n) / (n * n * (n - 1))))
            )

        return _let(above, score)

    def serial_test(values: Column, n: Column) -> Column:
        mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n

        def score(m: Column) -> Column:
            spread = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))
            together = neighbours(values, n, lambda a, b: (a - m) * (b - m))
            return _let(spread, lambda d: F.when(d == 0, F.lit(0.0)).otherwise(two_sided((together / d + 1 / n) * F.sqrt(n))))

        return _let(mean, score)

    def judged(x: Column) -> Column:
        core, chars, e = x["core"], x["chars"], x["encoding"]
        n, k = F.size(chars).cast("double"), _pick([float(len(a)) for a in ENCODINGS], e)
        alphabet = _pick(list(ENCODINGS), e)
        values = F.transform(chars, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))

        def with_pairs(equal: Column) -> Column:
            uniform = moments(n, 1 / k, 1 / (k * k))
            usual = moments(n, _pick([a for a, _ in ordinary], e), _pick([b for _, b in ordinary], e))
            p = [upper_tail(normal(equal, *uniform))]
            p += [_let(values, lambda v: runs_test(v, n, k)), _let(values, lambda v: serial_test(v, n))]
            logs = sum((F.ln(F.greatest(q, F.lit(1e-300))) for q in p), F.lit(0.0))
            fisher = _let(-logs, lambda h: F.exp(-h) * (1 + h + h * h / 2))
            return F.struct(fisher.alias("p_random"), upper_tail(-normal(equal, *usual)).alias("p_ordinary"))

        return _let(equal_pairs(core, chars), with_pairs)

    whole = F.struct(core.alias("core"), F.filter(F.split(core, ""), lambda c: c != "").alias("chars"), encoding.alias("encoding"))
    return _let(whole, judged)


def _bin(p: Column) -> Column:
    """The step of the largest 10 ** (-step / STEPS) that isn't below p."""
    return F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DECADES))) * STEPS).cast("int")


def candidates(text: Column, ordinary: list[tuple[float, float]]) -> Column:
    """Strings that the battery doesn't reject, with the step of their probability under ordinary text; others as step 0."""

    def judged(m: Column) -> Column:
        def result(p: Column) -> Column:
            step = F.when(p["p_random"] >= REJECTED_SHARE, _bin(p["p_ordinary"])).otherwise(F.lit(0))
            size = F.floor(F.log2(F.length(m["hit"]).cast("double"))).cast("int")
            return F.struct(
                m["start"].alias("start"), m["end"].alias("end"), size.alias("size_class"), step.alias("step"), F.xxhash64(m["hit"]).alias("token")
            )

        return _let(tested(m["hit"], ordinary), result)

    unknown = F.filter(matches(text, CANDIDATE), lambda m: ~m["hit"].rlike(KNOWN))
    return F.transform(unknown, judged)


def thresholds(found: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """The least step of each class of lengths at which the Benjamini-Hochberg rule reports.

    Classes of lengths and steps number a few dozen and 800, whatever the input.
    """
    tokens = found.select(F.explode("candidates").alias("c")).select("c.size_class", "c.step", "c.token").distinct()
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("size_class", "step").count().collect():
        counts.setdefault(r.size_class, {})[r.step] = r["count"]
    out = {}
    for size_class, steps in counts.items():
        total, reported = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            reported += steps[step]
            # Every probability of this step is at most 10 ** (-step / STEPS).
            if step and 10.0 ** (-step / STEPS) * total / reported <= false_share:
                out[size_class] = step
    return out


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end), of every row; kinds are places in KINDS.

    Positions count code points, ends are exclusive. Spans of the patterns always stay; random
    strings that are not such a span themselves are added, also inside the value of an assignment.
    Defined results: a null text is empty; empty texts and texts without a span get an empty array; repeated
    rows and null ids are kept as they come; an empty table gives no row. Other columns aren't read.
    """
    ordinary = coincidence(symbol_frequencies(docs, text))
    content = F.coalesce(F.col(text), F.lit(""))
    found = staged(docs.select(F.col(doc_id).alias("doc_id"), base_spans(content).alias("base"), candidates(content, ordinary).alias("candidates")), "spans")
    limits = thresholds(found, false_share)
    if not limits:
        return found.select("doc_id", F.col("base").alias("spans"))
    least = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    random = F.transform(
        F.filter("candidates", lambda c: c["step"] >= F.coalesce(F.try_element_at(least, c["size_class"]), F.lit(DECADES * STEPS + 1))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")),
    )
    return found.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the hash of the patterns' spans, and all spans as text."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
