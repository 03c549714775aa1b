"""Quality rules: a threshold table compiled into one native projection.

Words are runs of characters other than ASCII white space.  Each rule is a row of a table
(name, numerator, denominator, least, most, words from which it holds); ``compile_rules`` turns the
table into one boolean expression per rule, and ``quality`` evaluates metrics and rules in a single
projection: no user functions, no shuffle, one pass over the text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for on with as was be by at this are or from an "
    "le la les de des du et un une en que qui pour dans sur par au aux avec est "
    "der die das und in den von zu mit ein eine ist im auf für nicht sich als auch dem "
    "el los las y un una por con para se del al es lo no su"
).split()


class Rule(NamedTuple):
    name: str
    part: str
    whole: str
    least: float | None
    most: float | None
    from_words: int = 0


RULES = (
    Rule("length", "n_words", "one", 10, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2, 25),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("bangs", "n_bangs", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.005, None, 100),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 0.5, 50),
)

_POS_BITS = 21
_POS = (1 << _POS_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed value once, however often the body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def covered(starts: Column, width: int) -> Column:
    """Words covered by windows of one width that begin at the sorted starts."""
    zero = F.struct(F.lit(-width).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width).cast("long"), p - acc["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the text.

    Window hashes carry their start in the low bits, so one primitive sort brings equal windows
    together.  Where a hash is shared by different windows, or a text is too long for the position
    bits, the windows themselves are sorted instead, so the count is exact.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0).cast("long"), (n - width).cast("long"))
    at = lambda i, k: F.get(words, (i + k).cast("int"))
    window = lambda i: F.array(*[at(i, k) for k in range(width)])
    high = lambda x: F.shiftright(x, _POS_BITS)
    low = lambda x: x.bitwiseAND(F.lit(_POS))
    none = F.lit(0).cast("long")

    def twins(s: Column, key: Callable[[Column], Column]) -> Column:
        return F.filter(s, lambda x, j: (key(x) == key(F.get(s, j - 1))) | (key(x) == key(F.get(s, j + 1))))

    def counted(d: Column) -> Column:
        clash = F.exists(F.transform(d, lambda x, j: (high(x) == high(F.get(d, j + 1))) & (window(low(x)) != window(low(F.get(d, j + 1))))), lambda c: c)
        return F.when(~F.coalesce(clash, F.lit(False)), covered(F.sort_array(F.transform(d, low)), width))

    slow = let(
        F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i")))),
        lambda s: covered(F.sort_array(F.transform(twins(s, lambda x: x["w"]), lambda x: x["i"])), width),
    )

    def quick(h: Column) -> Column:
        keyed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long")))
        by_hash = F.when(n <= _POS, let(let(F.sort_array(keyed), lambda s: twins(s, high)), counted))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.coalesce(by_hash, slow))

    hashes = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: chained(h, width))
    return F.when(n < width, none).otherwise(let(hashes, quick))


def chained(h: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` neighbours, each step from the hashes of the last."""
    out, n = h, F.size(h)
    for k in range(1, width):
        out = let(out, lambda p, k=k: F.zip_with(F.slice(p, 1, n - k), F.slice(h, k + 1, n - k), lambda a, b: F.xxhash64(a, b)))
    return out


def metrics(text: Column) -> dict[str, Column]:
    """All counts of the rule table, as expressions on one text column (null: empty)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    trimmed = F.btrim(text, F.lit(WS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "of_words": of_words,
        "of_lines": of_lines,
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_bangs": F.regexp_count(text, F.lit("!")).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...], value: Callable[[str], Column]) -> dict[str, Column]:
    """One expression per rule: true where the text passes (ratios as products: no division)."""
    out = {}
    for r in rules:
        part, whole = value(r.part), F.lit(1) if r.whole == "one" else value(r.whole)
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (part >= whole * F.lit(r.least))
        if r.most is not None:
            ok = ok & (part <= whole * F.lit(r.most))
        out[r.name] = ok | (value("n_words") < r.from_words)
    return out


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add a struct ``quality`` (metrics, ``base_failed``, ``failed_rules``, ``kept``) to each row.

    Null and empty texts have no words and fail; repeated rows are judged alike; very long texts are measured whole;
    an empty table gives none; other columns pass through, but one named ``quality`` is replaced.
    """
    m = metrics(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("quality", let(F.struct(*[c.alias(k) for k, c in m.items()]), lambda got: verdict(got, rules)))


def verdict(got: Column, rules: tuple[Rule, ...]) -> Column:
    def value(k: str) -> Column:
        if k in ("n_words", "word_chars", "n_repeat_words", "n_stop_words"):
            return got["of_words"][k]
        return got["of_lines"][k] if k in ("n_lines", "n_dup_lines") else got[k]

    base_failed = (value("n_words") < 10) | (100 * value("n_repeat_words") > 20 * value("n_words"))
    judged = compile_rules(rules, value)
    names = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    return F.struct(
        *[value(k).alias(k) for k in names],
        base_failed.alias("base_failed"),
        F.array_compact(F.array(*[F.when(~ok, F.lit(k)) for k, ok in judged.items()])).alias("failed_rules"),
        (~base_failed & F.forall(F.array(*judged.values()), lambda x: x)).alias("kept"),
    )
