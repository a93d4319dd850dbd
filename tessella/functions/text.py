"""Formulas and key=value text as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used and inside whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _counts(formula: Column) -> Column:
    """array<struct<el, n>> of a flat formula such as Fe2O3, equal elements added, sorted."""
    els = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(1))
    ns = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(2))
    pairs = F.zip_with(els, ns, lambda e, n: F.struct(e.alias("el"), F.coalesce(F.nullif(n, F.lit("")).cast("long"), F.lit(1)).alias("n")))
    return F.transform(
        F.array_sort(F.array_distinct(els)),
        lambda e: F.struct(
            e.alias("el"),
            F.aggregate(F.filter(pairs, lambda p: p["el"] == e), F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n"),
        ),
    )


def _gcd(a: Column, b: Column) -> Column:
    """Euclid in as many steps as the smaller number's Fibonacci bound asks for (at most 95); stops changing at (g, 0)."""
    steps = 4 + F.ceil(1.4405 * F.log2(F.least(F.abs(a), F.abs(b)) + 1.0))
    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), steps),
        F.struct(a.alias("a"), b.alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))),
        lambda s: s["a"],
    )


def composition_key(formula: Column | str) -> Column:
    """Reduced composition, elements sorted: Fe4O6 -> Fe2|O3; NULL if there is no element."""
    f = F.col(formula) if isinstance(formula, str) else formula
    counts = _counts(f)
    g = F.aggregate(F.transform(counts, lambda p: p["n"]), F.lit(0).cast("long"), lambda a, n: _gcd(n, a))
    parts = F.transform(counts, lambda p: F.concat(p["el"], (p["n"] / F.nullif(g, F.lit(0))).cast("long").cast("string")))
    return F.when(F.size(counts) > 0, F.array_join(parts, "|"))


def chemical_system(formula: Column | str) -> Column:
    f = F.col(formula) if isinstance(formula, str) else formula
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(f, F.lit("[A-Z][a-z]?"), F.lit(0)))), "-")


def key_values(comment: Column | str) -> Column:
    """map of key=value pairs; values may stand in double quotes; the last of a key wins."""
    c = F.col(comment) if isinstance(comment, str) else comment
    pattern = F.lit('([A-Za-z_][A-Za-z0-9_]*)=("[^"]*"|[^ \\t"]+)')
    keys = F.regexp_extract_all(c, pattern, F.lit(1))
    values = F.transform(F.regexp_extract_all(c, pattern, F.lit(2)), lambda v: F.btrim(v, F.lit('"')))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def fractional_formula(formula: Column | str) -> Column:
    """map of element to its amount, amounts with or without decimals (Ca0.5Sr0.5TiO3); equal elements are added."""
    f = F.col(formula) if isinstance(formula, str) else formula
    pattern = F.lit(r"([A-Z][a-z]?)([0-9]*\.?[0-9]*)")
    els, ns = F.regexp_extract_all(f, pattern, F.lit(1)), F.regexp_extract_all(f, pattern, F.lit(2))
    pairs = F.zip_with(els, ns, lambda e, n: F.struct(e.alias("el"), F.coalesce(F.nullif(n, F.lit("")).try_cast("double"), F.lit(1.0)).alias("n")))

    def added(p: Column) -> Column:
        add = lambda e: F.aggregate(F.filter(p, lambda x: x["el"] == e), F.lit(0.0), lambda a, x: a + x["n"])
        return _let(F.array_sort(F.array_distinct(p["el"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, add)))

    return _let(pairs, added)


def nearest_fraction(value: Column, most: int = 10_000) -> Column:
    """struct<num, den>: the fraction with a denominator of at most ``most`` that lies nearest to a number of at most 12 decimals.

    The continued fraction's convergents up to the bound, then the better of the last
    one and the last semiconvergent (the convergent, if both are as near).
    """
    unit = 10**12
    whole = (value.cast("decimal(30,12)") * unit).cast("decimal(38,0)").cast("long")
    long = lambda n: F.lit(n).cast("long")
    names = ("p0", "q0", "p1", "q1", "n", "d", "done")
    state = lambda *values: F.struct(*[v.alias(n) for n, v in zip(names, values)])

    def step(s: Column, _: Column) -> Column:
        a = F.round((s["n"] - s["n"] % F.nullif(s["d"], F.lit(0))) / s["d"]).cast("long")
        nxt = state(s["p1"], s["q1"], s["p0"] + a * s["p1"], s["q0"] + a * s["q1"], s["d"], s["n"] - a * s["d"], F.lit(False))
        over = (s["d"] == 0) | (s["q0"] + a * s["q1"] > most)
        # Once over, the steps left do nothing.
        return F.when(s["done"], s).when(over, state(*[s[n] for n in names[:-1]], F.lit(True))).otherwise(nxt)

    def chosen(s: Column) -> Column:
        k = F.floor((most - s["q0"]) / s["q1"])
        num, den = s["p0"] + k * s["p1"], s["q0"] + k * s["q1"]
        last = (s["d"] == 0) | (2 * s["d"] * den <= unit)
        return F.struct(F.when(last, s["p1"]).otherwise(num).alias("num"), F.when(last, s["q1"]).otherwise(den).alias("den"))

    # Denominators grow at least like Fibonacci's numbers.
    steps = 3 + int(2.1 * most.bit_length())
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(long(0), long(1), long(1), long(0), whole, long(unit), F.lit(False)), step, chosen)


def rational_key(formula: Column | str, most: int = 10_000) -> Column:
    """Reduced whole-number composition of a formula with decimal amounts, each taken as its nearest fraction: Ca0.333333Ti0.666667 -> Ca1|Ti2.

    NULL without an element, or where the whole numbers don't fit 64 bits.
    """

    def common(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(1).cast("long"), lambda a, x: F.try_multiply(a, (x["den"] / _gcd(a, x["den"])).cast("long")))

    def wholes(parts: Column) -> Column:
        return _let(common(parts), lambda c: F.transform(parts, lambda x: F.try_multiply(x["num"], (c / x["den"]).cast("long"))))

    def joined(keys: Column, whole: Column, g: Column) -> Column:
        out = F.zip_with(keys, whole, lambda e, n: F.concat(e, (n / F.nullif(g, F.lit(0))).cast("long").cast("string")))
        return F.when((F.size(keys) > 0) & ~F.exists(whole, lambda n: n.isNull()), F.array_join(out, "|"))

    def key(m: Column) -> Column:
        parts = F.transform(F.map_values(m), lambda v: nearest_fraction(v, most))
        divisor = lambda whole: F.aggregate(whole, F.lit(0).cast("long"), lambda a, n: _gcd(n, a))
        return _let(parts, lambda p: _let(wholes(p), lambda w: _let(divisor(w), lambda g: joined(F.map_keys(m), w, g))))

    return _let(fractional_formula(formula), key)


def with_rational_key(df: DataFrame, formula: str, name: str) -> DataFrame:
    """``df`` with each formula's ``rational_key``, which is some tenths of a millisecond's work: done once a distinct formula, dealt by it."""
    keys = df.select(formula).distinct().select(formula, rational_key(formula).alias(name))
    return df.join(keys, formula, "left")


def leaky_names(names: list[str], blocked: list[str]) -> list[str]:
    """The names that contain a blocked substring, whatever the case of letters."""
    return [n for n in names if any(b.lower() in n.lower() for b in blocked)]


def outside_vocabulary(names: list[str], vocabulary: set[str]) -> list[str]:
    return sorted(set(names) - set(vocabulary))


def is_digest(c: Column | str) -> Column:
    """Whether the whole text is a lower-case sha256 in hex."""
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\A[0-9a-f]{64}\z")
