"""Secrets by patterns and by a battery of randomness tests, with DataFrame operations only.

Patterns give the kinds ``assign``, ``access`` and ``hex``.  The battery adds ``random``: runs of at least
20 characters that could encode random bytes and behave like it.

*Encoding*, inferred from the characters present: hexadecimal (either case), base32, alphanumeric (62) or
base64 (either variant, 64).  Each character is its number in that alphabet.

*Tests*, each with a p-value under "uniformly random":
 chi-squared of the character counts, by its exact mean and variance for the length (one-sided: short
 texts over 64 characters have no use for the asymptotic distribution);
 runs above and below the middle of the alphabet (two-sided);
 correlation of each character with the next (two-sided).
The smallest of the three counts, corrected for their number: 1 - (1 - p)^3.

*False discoveries.*  Here a discovery is a run that was not rejected.  Among runs of one encoding and one
length class (a power of two; what the tests can tell depends on the length), random ones have uniform
p-values and others crowd at 0.  Those above 1/2 tell how many are random (twice as many), so at each cut
the expected share of others above it is known.  The smallest cut of 64 whose share is at most ``rate`` is
used; a class without such a cut gives nothing.  A class of few runs is pooled with the next lengths of its encoding, so that a lone key
of a rare length is judged beside others.  Counts are over all rows; what comes back to the driver is
one cut per encoding and length class, at most 5 x 31.

Spans are code points, end exclusive; a random run that overlaps a pattern's span is left out.

Defined cases: NULL is the empty text and has no span.  Repeated rows are answered each and count each.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RATE = 0.05
LEAST_RUN = 20
CUTS = 64
_LOWER = "abcdefghijklmnopqrstuvwxyz"
# Alphabets in the order of their symbols' values, and which runs they fit; the first that fits counts.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _LOWER.upper() + "234567"),
    ("base62", "^[A-Za-z0-9]+$", _LOWER.upper() + _LOWER + "0123456789"),
    ("base64", "^[A-Za-z0-9+/_-]+$", _LOWER.upper() + _LOWER + "0123456789+/"),
]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
# The value of an assignment begins after the sign that follows the name.
_ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
KINDS = ["assign", "access", "hex", "random"]
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_FOUND = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"
BLOCK = 256  # matches whose places are found together
LEAST_CLASS = 50  # runs; length classes of fewer are pooled with those nearest in length


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda's body is computed anew for each element)."""
    return F.transform(F.array(value), body)[0]


def _scanned(items: Column, start: Column, step, emit, empty: Column) -> Column:
    """The array of ``emit(state, item)``, where ``state`` is ``start`` after a ``step(state, item)`` for each item before.

    An array that grows by one element is copied each time, so items are taken in blocks: first only the state runs through
    them, then each block grows an array of its own.  ``empty`` is an empty array of the result's type.
    """
    kind = F.array().cast("array<bigint>")

    def cut(xs: Column) -> Column:
        last = F.greatest(F.ceil(F.size(xs) / BLOCK).cast("int"), F.lit(1)) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))

    def before(blocks: Column) -> Column:
        def pass_on(acc: Column, block: Column) -> Column:
            return F.struct(
                F.aggregate(block, acc["state"], step).alias("state"),
                F.concat(acc["states"], F.array(acc["state"])).alias("states"),
            )

        return F.aggregate(blocks, F.struct(start.alias("state"), kind.alias("states")), pass_on, lambda acc: acc["states"])

    def walk(block: Column, state: Column) -> Column:
        def add(acc: Column, item: Column) -> Column:
            return F.struct(
                step(acc["state"], item).alias("state"),
                F.concat(acc["out"], F.array(emit(acc["state"], item))).alias("out"),
            )

        return F.aggregate(block, F.struct(state.alias("state"), empty.alias("out")), add, lambda acc: acc["out"])

    return _let(
        items,
        lambda xs: _let(cut(xs), lambda blocks: _let(before(blocks), lambda states: F.flatten(F.zip_with(blocks, states, walk)))),
    )


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Structs (start, kind, end, found) of the leftmost non-overlapping matches that ``keep`` accepts.

    What lies between the matches gives their places: starts are sums of the lengths before them.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(between, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    empty = F.array().cast(_FOUND)

    def step(at: Column, item: Column) -> Column:
        return at + item["gap"] + F.length(item["match"])

    def emit(at: Column, item: Column) -> Column:
        return F.struct(
            (at + item["gap"]).alias("start"), F.lit(kind).alias("kind"), step(at, item).alias("end"),
            item["match"].alias("found"),
        )

    matches = F.filter(lengths, lambda item: item["match"].isNotNull())
    walked = F.filter(_scanned(matches, F.lit(0).cast("long"), step, emit, empty), lambda s: keep(s["found"]))
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _clear_of(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps, by two walks over both in order of their starts."""
    far = F.lit(1 << 62).cast("long")

    def is_base(item: Column) -> Column:
        return item["kind"] < 3

    def marked(item: Column, hit: Column) -> Column:
        return F.struct(item["start"], item["kind"], F.when(hit, -1).otherwise(item["end"]).alias("end"), item["found"])

    def ahead(items: Column) -> Column:  # the furthest end of the base spans so far
        return _scanned(
            items, F.lit(0).cast("long"),
            lambda end, x: F.when(is_base(x), F.greatest(end, x["end"])).otherwise(end),
            lambda end, x: marked(x, ~is_base(x) & (end > x["start"])), F.array().cast(_FOUND),
        )

    def behind(items: Column) -> Column:  # the nearest start of the base spans after it
        return _scanned(
            items, far,
            lambda start, x: F.when(is_base(x), F.least(start, x["start"])).otherwise(start),
            lambda start, x: marked(x, ~is_base(x) & (start < x["end"])), F.array().cast(_FOUND),
        )

    every = F.array_sort(F.concat(base, runs))
    kept = F.filter(behind(F.reverse(ahead(every))), lambda x: ~is_base(x) & (x["end"] >= 0))
    return F.when((F.size(runs) > 0) & (F.size(base) > 0), kept).otherwise(runs)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the rational approximation 26.2.17 of the Handbook of
    Mathematical Functions (error below 1e-7)."""
    x = F.abs(z)
    t = F.lit(1.0) / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(symbols: Column, size: int) -> Column:
    """The corrected smallest p-value of the three tests on an array of symbol numbers."""
    n = F.size(symbols).cast("double")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    counts = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda s: F.size(F.filter(symbols, lambda x: x == s)).cast("double"),
    )
    squared = total(F.transform(counts, lambda c: c * c)) * size / n - n
    uniform = _upper_tail((squared - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
    high = F.transform(symbols, lambda x: (x >= size / 2).cast("int"))
    above = total(F.transform(high, lambda x: x.cast("double")))
    pairs = F.zip_with(
        F.slice(symbols, F.lit(1), F.size(symbols) - 1), F.slice(symbols, F.lit(2), F.size(symbols) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    changes = total(F.transform(pairs, lambda p: ((p["a"] >= size / 2) != (p["b"] >= size / 2)).cast("double")))
    product = 2 * above * (n - above)
    spread = product * (product - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, F.least(F.lit(1.0), 2 * _upper_tail(F.abs(changes - product / n) / F.sqrt(spread))))
    mean = total(F.transform(symbols, lambda x: x.cast("double"))) / n
    variance = total(F.transform(symbols, lambda x: (x - mean) * (x - mean)))
    covariance = total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)))
    serial = F.when(
        variance > 0, F.least(F.lit(1.0), 2 * _upper_tail(F.abs(covariance / variance + 1 / n) * F.sqrt(n)))
    )
    # All symbols on one side, or all equal: as far from random as can be.
    least = F.least(uniform, F.coalesce(runs, F.lit(0.0)), F.coalesce(serial, F.lit(0.0)))
    return 1 - F.pow(1 - least, F.lit(3.0))


def _symbols(run: Column, alphabet: str) -> Column:
    plain = F.translate(run, "-_", "+/") if "+" in alphabet else run
    return F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def _tested(run: Column) -> Column:
    """Struct of encoding (number), length class and p-value of a run."""
    number, value = F.lit(len(ENCODINGS) - 1), None
    for i, (_, fits, alphabet) in reversed(list(enumerate(ENCODINGS))):
        p = _battery(_symbols(run, alphabet), len(alphabet))
        value = p if value is None else F.when(run.rlike(fits), p).otherwise(value)
        number = F.when(run.rlike(fits), F.lit(i)).otherwise(number)
    length_class = F.floor(F.log2(F.length(run).cast("double"))).cast("int")
    return F.struct(number.alias("encoding"), length_class.alias("length"), value.alias("p"))


def _cuts(runs: DataFrame, rate: float) -> dict[tuple[int, int], float]:
    """The smallest p-value to report, by encoding and length class; classes with none are missing."""
    bin_of = F.least(F.lit(CUTS - 1), F.floor(F.col("p") * CUTS).cast("int"))
    rows = runs.groupBy("encoding", "length", bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()
    classes: dict[tuple[int, int], list[int]] = {}
    for row in rows:  # at most 5 encodings x 31 lengths x 64 bins
        classes.setdefault((row.encoding, row.length), [0] * CUTS)[row.bin] += row.n
    cuts = {}
    for key in classes:
        counts = _pooled(classes, *key)
        truly = 2 * sum(counts[CUTS // 2 :])
        for cut in range(CUTS // 2 + 1):
            above = sum(counts[cut:])
            others = above - truly * (1 - cut / CUTS)
            if above and truly and others <= rate * above:
                cuts[key] = cut / CUTS
                break
    return cuts


def _pooled(classes: dict[tuple[int, int], list[int]], encoding: int, length: int) -> list[int]:
    """Counts of a class, with those of its encoding's next length classes while they are too few to tell from."""
    counts = [0] * CUTS
    near = sorted((abs(other - length), other) for code, other in classes if code == encoding)
    for _, other in near:
        counts = [a + b for a, b in zip(counts, classes[encoding, other], strict=True)]
        if sum(counts) >= LEAST_CLASS:
            break
    return counts


def find_secrets(docs: DataFrame, rate: float = RATE, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind number, end, in order) of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = lambda m: F.length(F.regexp_extract(m, _ASSIGNED, 1)) >= 6
    base = F.concat(
        _spans(text, PATTERNS["assign"], 0, assigned),
        _spans(text, PATTERNS["access"], 1, lambda m: F.length(m) >= 20),
        _spans(text, "[0-9a-f]{24,}", 2, lambda m: F.length(m) >= 24),
    )
    runs = _spans(text, rf"[A-Za-z0-9+/_-]{{{least_run},}}", 3, lambda m: F.length(m) >= least_run)
    found = docs.select("doc_id", F.array_sort(base).alias("known"), runs.alias("others"))
    plain = F.transform("known", lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(_SPAN)
    tested = F.transform(
        _clear_of(F.col("others"), F.col("known")),
        lambda r: F.struct(r["start"], r["kind"], r["end"], _tested(r["found"]).alias("test")),
    )
    # The texts are not needed any more: spans and p-values are.
    held = written(found.select("doc_id", plain.alias("base"), tested.alias("runs")))
    cuts = _cuts(held.select(F.explode("runs").alias("r")).select("r.test.*"), rate)
    # One cut per encoding and length class; no p-value reaches 2.
    table = F.array(*[F.lit(cuts.get((e, n), 2.0)) for e in range(len(ENCODINGS)) for n in range(32)])
    place = lambda r: r["test"]["encoding"] * 32 + r["test"]["length"] + 1
    chosen = F.filter("runs", lambda r: r["test"]["p"] >= F.element_at(table, place(r)))
    random = F.transform(chosen, lambda r: F.struct(r["start"], r["kind"], r["end"]))
    return held.select(
        "doc_id", "base", F.array_sort(F.concat("base", random.cast(_SPAN))).alias("spans")
    )


def as_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")
