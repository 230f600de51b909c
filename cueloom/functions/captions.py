"""Screen captions as text: folding of width and variants, cleaning of noise, quality, likeness.  Columns only.

`variants` is a pair of strings of equal length, each character of the first standing for the one of the second (traditional to simplified
signs, say); none is built in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueloom.functions import text as tx

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
Variants = tuple[str, str]
NO_VARIANTS: Variants = ("", "")

# Fixed values of the caption rules.
QUALITY_WEIGHTS = {"length": 0.42, "cjk": 0.36, "not_latin": 0.16, "not_noise": 0.06}
FULL_LENGTH = 14.0
SAME_LINE = 0.88
NAME_PREFIX = r"^(?:[@#]?[A-Za-z][A-Za-z0-9_-]{0,7}\s+)+([一-鿿぀-ヿ가-힣])"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `then`."""
    return F.transform(F.array(value), then)[0]


def folded(text: Column, variants: Variants = NO_VARIANTS) -> Column:
    """Full-width signs to ASCII, variants to their standard form, null to empty."""
    return F.translate(F.coalesce(text, F.lit("")), WIDE + variants[0], NARROW + variants[1])


def norm(text: Column, variants: Variants = NO_VARIANTS) -> Column:
    return tx.candidate_text(folded(text, variants))


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _facts(line: Column) -> Column:
    return let(tx.candidate_text(line), lambda n: F.struct(
        line.alias("line"), n.alias("norm"), F.length(n).alias("n"), _without(n, "[一-鿿]").alias("cjk"), _without(n, "[a-z]").alias("latin"), _without(n, r"\p{Nd}").alias("digits")))


def _noise(f: Column, beside_cjk: Column | bool = True) -> Column:
    """No letters at all; beside a line of CJK text also a short Latin scrap or a few signs that are mostly Latin or digits."""
    scrap = (f["cjk"] == 0) & (f["n"] <= 10) & (f["latin"] >= F.least(F.lit(3), f["n"]))
    signs = (f["cjk"] <= 1) & (f["n"] <= 4) & (f["latin"] + f["digits"] >= F.greatest(F.lit(2), f["n"] - 1))
    return (f["n"] == 0) | (F.lit(beside_cjk) if isinstance(beside_cjk, bool) else beside_cjk) & (scrap | signs)


def _quality(facts: Column) -> Column:
    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(facts, F.lit(0), lambda s, f: s + of(f))

    sums = F.struct(total(lambda f: f["n"]).alias("n"), total(lambda f: f["cjk"]).alias("cjk"), total(lambda f: f["latin"]).alias("latin"), total(lambda f: _noise(f).cast("int")).alias("noise"))

    def score(s: Column) -> Column:
        n, lines = F.greatest(F.lit(1), s["n"]), F.greatest(F.lit(1), F.size(facts))
        parts = {"length": F.least(F.lit(1.0), s["n"] / FULL_LENGTH), "cjk": s["cjk"] / n, "not_latin": 1.0 - F.least(F.lit(1.0), s["latin"] / n), "not_noise": 1.0 - F.least(F.lit(1.0), s["noise"] / lines)}
        weighed = sum((parts[k] * w for k, w in list(QUALITY_WEIGHTS.items())[1:]), parts["length"] * QUALITY_WEIGHTS["length"])
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighed))

    return F.when(F.size(facts) == 0, 0.0).otherwise(let(sums, score))


def lines(text: Column, variants: Variants = NO_VARIANTS) -> Column:
    """Lines that are not blank, with single blanks."""
    return F.filter(F.transform(F.split(folded(text, variants), r"\r\n|[\r\n]"), lambda x: tx.strip_spaces(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def quality(text: Column, variants: Variants = NO_VARIANTS) -> Column:
    """0 to 1: longer, more CJK, less Latin, fewer noise lines."""
    return let(F.transform(lines(text, variants), _facts), _quality)


def likeness(a: Column, b: Column) -> Column:
    """1 - edits / longer length of two normalised texts; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(tx.edit_similarity(a, b))


def contained(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _better(a: Column, b: Column) -> Column:
    """The line of higher quality, the longer one if equal, the first if as long."""
    qa, qb = _quality(F.array(a)), _quality(F.array(b))
    return let(F.struct(qa.alias("a"), qb.alias("b")), lambda q: F.when(q["b"] > q["a"] + 1e-6, b).when(q["a"] > q["b"] + 1e-6, a).when(b["n"] > a["n"], b).otherwise(a))


def cleaned(text: Column, variants: Variants = NO_VARIANTS) -> Column:
    """The caption without name prefixes of CJK lines, noise lines and lines that repeat the one before; all lines stay if all are noise."""
    def drop_noise(facts: Column) -> Column:
        beside_cjk = F.exists(facts, lambda f: f["cjk"] >= 2)
        stripped = F.transform(facts, lambda f: _facts(tx.strip_spaces(F.regexp_replace(f["line"], NAME_PREFIX, "$1"))))
        return let(F.struct(stripped.alias("all"), beside_cjk.alias("cjk")), lambda s: let(F.filter(s["all"], lambda f: ~_noise(f, s["cjk"])), lambda k: F.when(F.size(k) == 0, s["all"]).otherwise(k)))

    def step(held: Column, f: Column) -> Column:
        last = F.element_at(held, -1)
        same = (F.size(held) > 0) & ((likeness(last["norm"], f["norm"]) >= SAME_LINE) | contained(last["norm"], f["norm"]))
        return F.when(same, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(_better(last, f)))).otherwise(F.concat(held, F.array(f)))

    kept = let(F.transform(lines(text, variants), _facts), drop_noise)
    return let(kept, lambda k: F.array_join(F.transform(F.aggregate(k, F.slice(k, 1, 0), lambda held, f: F.when(F.size(held) == 0, F.array(f)).otherwise(step(held, f))), lambda f: f["line"]), "\n"))


def joined(left: Column, right: Column) -> Column:
    """Two cleaned captions as one; ASCII words do not fuse."""
    blank = left.rlike("[A-Za-z0-9]$") & right.rlike("^[A-Za-z0-9]")
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, F.when(blank, " ").otherwise(""), right))
