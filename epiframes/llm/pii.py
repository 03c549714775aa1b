"""Personal data by weak supervision, in DataFrame expressions only.

Exact patterns (email, ip, card, phone) give base spans, which always stay.  Wider candidates (secrets,
identity numbers) are judged: regex, gazetteer and context labelers each vote yes, no or nothing;
expectation-maximisation over the counts of vote patterns estimates every labeler's reliability without
labels; its posteriors train a logistic classifier on span features.  Text is read once: spans with votes
and features are written without the text, and everything after works on that small table.  What
reaches the driver are counts by vote and feature pattern, whose number is bounded by their definition.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .quality import let

#: Base kinds in their order.  Possessive forms and look-behinds keep long runs linear; \G lets a match start where the last ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
#: Further kinds, judged by the classifier.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
    "id_number": r"(?<![0-9A-Za-z.+-])[0-9]{7,13}+(?![0-9A-Za-z])",
}
#: What a text must hold for a kind's pattern to be looked for: no match of the pattern is without it.
GUARDS = {"secret": "[A-Za-z0-9_/+=-]{20}", "id_number": "[0-9]{7}"}
#: Words that announce a secret or an identity number.
GAZETTEER = "token|key|secret|password|passwd|apikey|bearer|auth|credential|ssn|passport|account|iban|tax|licence|license"
KINDS = (*BASE, *CANDIDATES)
#: Values that are folded at a time, characters of a page, and base spans that candidates are compared with one by one.
BLOCK, PAGE, FEW = 512, 1024, 16
_SPAN = "array<struct<start:int,end:int,kind:int,votes:array<int>,features:array<int>>>"


def running(values: Column, merge: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What ``merge`` makes of 0 and all earlier values, for each value of an int array.

    Arrays are folded in blocks of ``BLOCK`` and the blocks' results in turn, so the work is linear.
    """

    def folded(v: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(v, zero, step, lambda acc: acc["out"])

    def blocked(v: Column, level: int) -> Column:
        if level == 1:
            return folded(v)
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

        def joined(b: Column) -> Column:
            totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0), merge))
            return let(totals, lambda t: F.flatten(F.zip_with(b, blocked(t, level - 1), lambda x, at: F.transform(folded(x), lambda y: merge(at, y)))))

        return F.when(F.size(v) <= BLOCK, folded(v)).otherwise(let(blocks, joined))

    return blocked(values, levels)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def located(text: Column, pattern: str, contexts: bool = False) -> Column:
    """All matches as structs (start, end, match): lengths of the matches and of the gaps between them add up.

    With ``contexts`` also the 24 characters before and the 8 after: four gaps and three matches of at least 7
    characters hold the former, a gap and a match the latter.
    """

    def place(m: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.length(g) + F.length(x))

            def made(at: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    start = at[i] + F.length(gaps[i])
                    fields = [start.alias("start"), (start + F.length(x)).alias("end"), x.alias("match")]
                    if contexts:
                        earlier = [y for k in (3, 2, 1) for y in (F.coalesce(F.get(gaps, i - k), F.lit("")), F.coalesce(F.get(m, i - k), F.lit("")))]
                        fields += [F.right(F.concat(*earlier, gaps[i]), F.lit(24)).alias("before"), F.left(F.concat(gaps[i + 1], F.coalesce(F.get(m, i + 1), F.lit(""))), F.lit(8)).alias("after")]
                    return F.struct(*fields)

                return F.transform(m, one)

            return let(running(lengths, _sum), made)

        kind = "array<struct<start:int,end:int,match:string" + (",before:string,after:string>>" if contexts else ">>")
        return F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def paged(text: Column) -> Column:
    """The text in pages of ``PAGE`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(pages: Column, start: Column, end: Column) -> Column:
    """Characters from start to end: only pages that hold them are read."""
    page = lambda i: F.coalesce(F.get(pages, i), F.lit(""))
    p, q = (start / PAGE).cast("int"), (end / PAGE).cast("int")
    across = F.concat(F.substring(page(p), start % PAGE + 1, F.lit(PAGE)), F.array_join(F.slice(pages, p + 2, F.greatest(q - p - 1, F.lit(0))), ""), F.substring(page(q), F.lit(1), end % PAGE))
    return F.when(p == q, F.substring(page(p), start % PAGE + 1, end - start)).otherwise(across)


def luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        v = c.cast("int") * (1 + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans as structs (start, end, kind, no votes, no features)."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}
    none = F.array().cast("array<int>")
    parts = []
    for code, kind in enumerate(BASE):
        spans = F.transform(_valid_only(located(text, PATTERNS[kind]), kind), _plain(code, none))
        parts.append(F.when(may[kind], spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


def _plain(code: int, none: Column):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(code).alias("kind"), none.alias("votes"), none.alias("features"))


def _valid_only(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: valid(kind, s["match"]))


class Vote(NamedTuple):
    """Votes of one candidate: 1 yes, -1 no, 0 nothing."""

    shape: Column
    gazetteer: Column
    context: Column
    mixture: Column
    letters: Column


def votes(kind: str, match: Column, before: Column, after: Column) -> Vote:
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    turns = F.regexp_count(match, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
    repeated = F.size(F.array_distinct(F.split(match, ""))) * 5 < F.length(match)
    known = F.lower(before).rlike(rf"(?:{GAZETTEER})[^a-z]*$")
    led = before.rlike(r"[=:]\s*[\"']?$")
    noisy = before.rlike(r"[|#$%&*]\s*$") | after.rlike(r"^\s*[|#$%&*]")
    if kind == "secret":
        shape = F.when(match.rlike("^[0-9a-f]{32,}$") | (match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")), yes).when(F.length(F.regexp_replace(match, "[^0-9]", "")) * 6 < F.length(match), no).otherwise(none)
        mixture = F.when(repeated | (turns < 3), no).otherwise(yes)
    else:
        shape = F.when(F.length(match) == 9, yes).when(F.length(match) < 8, no).otherwise(none)
        mixture = F.when(repeated, no).otherwise(none)
    return Vote(
        shape,
        F.when(known, yes).otherwise(none),
        F.when(led, yes).when(noisy, no).otherwise(none),
        mixture,
        F.when(match.rlike("^[A-Za-z_/+=-]+$"), no).otherwise(none),
    )


#: How many levels each span feature has.
FEATURES = {"kind": 2, "length": 6, "digits": 5, "led": 2, "known": 2, "quoted": 2, "upper": 2}


def features(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    share = F.length(F.regexp_replace(match, "[^0-9]", "")) / F.length(match)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [
        F.lit(list(CANDIDATES).index(kind)),
        F.least(F.lit(5), (F.length(match) / 8).cast("int")),
        F.least(F.lit(4), (share * 4).cast("int")),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(F.lower(before).rlike(rf"(?:{GAZETTEER})[^a-z]*$")),
        flag(after.rlike(r"^[\"']")),
        flag(match.rlike("[A-Z]")),
    ]


def candidate_spans(text: Column, base: Column, marks: Column | None = None) -> Column:
    """Candidates that overlap no base span, with votes and features.  ``marks`` serves texts with many base spans."""
    parts = []
    for kind, pattern in CANDIDATES.items():
        code = KINDS.index(kind)

        def shaped(s: Column, kind: str = kind, code: int = code) -> Column:
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(code).alias("kind"), F.array(*votes(kind, s["match"], s["before"], s["after"])).alias("votes"), F.array(*features(kind, s["match"], s["before"], s["after"])).alias("features"))

        found = located(text, pattern, contexts=True)
        free = _without(found, base) if marks is None else let(found, lambda x: F.when(F.size(base) <= FEW, _without(x, base)).otherwise(_outside(x, marks)))
        parts.append(F.when(text.rlike(GUARDS[kind]), _shaped(free, shaped).cast(_SPAN)).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


def _without(found: Column, base: Column) -> Column:
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _outside(found: Column, marks: Column) -> Column:
    return F.filter(found, lambda s: ~F.contains(cut(marks, s["start"], s["end"]), F.lit("1")))


def marked(base: Column) -> Column:
    """Pages with a character for each one of the text: 1 in base spans, else 0."""

    def line(spans: Column, far: Column) -> Column:
        def mark(s: Column, i: Column) -> Column:
            gap, own = F.greatest(s["start"] - far[i], F.lit(0)), F.greatest(s["end"] - F.greatest(s["start"], far[i]), F.lit(0))
            return F.concat(F.repeat(F.lit("0"), gap), F.repeat(F.lit("1"), own))

        return paged(F.array_join(F.transform(spans, mark), ""))

    ordered = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    return let(ordered, lambda spans: let(running(F.transform(spans, lambda s: s["end"]), _most), lambda far: line(spans, far)))


def _shaped(free: Column, fn) -> Column:
    return F.transform(free, lambda s: fn(s))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over vote patterns with counts: the share of true spans, and for each labeler and vote its
    probability among false and true spans (abstaining included).  Starts from the majority vote."""
    if not patterns:
        return 0.5, []
    m = len(patterns[0][0])
    post = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns]
    prior, table = 0.5, [{} for _ in range(m)]
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        true = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        prior = min(0.99, max(0.01, true / total))
        table = []
        for j in range(m):
            sums = {x: [1.0, 1.0] for x in (-1, 0, 1)}
            sums[1][1] += 2.0  # a labeler is taken to be better than chance
            sums[-1][0] += 2.0
            for p, (v, n) in zip(post, patterns, strict=True):
                sums[v[j]][1] += p * n
                sums[v[j]][0] += (1 - p) * n
            whole = [sum(s[c] for s in sums.values()) for c in (0, 1)]
            table.append({x: (s[0] / whole[0], s[1] / whole[1]) for x, s in sums.items()})
        post = [posterior(v, prior, table) for v, _ in patterns]
    return prior, table


def posterior(v: tuple[int, ...], prior: float, table: list[dict[int, tuple[float, float]]]) -> float:
    score = math.log(prior / (1 - prior)) + sum(math.log(t[x][1] / t[x][0]) for x, t in zip(v, table, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))


def fit_spans(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[float, list[list[float]]]:
    """Logistic regression on one-hot features; rows: (levels, weight, share that is true)."""
    weights = [[0.0] * n for n in FEATURES.values()]
    bias, total = 0.0, sum(w for _, w, _ in rows) or 1.0
    for _ in range(rounds):
        g_bias, g = 0.0, [[0.0] * n for n in FEATURES.values()]
        for levels, w, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[j][x] for j, x in enumerate(levels))))))
            d = (p - y) * w / total
            g_bias += d
            for j, x in enumerate(levels):
                g[j][x] += d
        bias -= rate * g_bias
        weights = [[a - rate * (b + ridge * a) for a, b in zip(u, v, strict=True)] for u, v in zip(weights, g, strict=True)]
    return bias, weights


def personal_data(docs: DataFrame, key: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: key columns and ``spans``, structs (start, end, kind) by start, then kind.

    Offsets are code points, the end exclusive.  Null and empty texts have no spans; repeated rows get
    the same spans; with no candidates at all only base spans are given.  Spans that start together are in the
    order of their kinds.  Very long texts are read whole, in time linear in the text and its matches.  An
    empty table gives none; columns that are not named in ``key`` are left out.
    """
    rows = docs.select(*key, text_or_empty(text).alias("_text"))
    found = rows.withColumn("_base", base_spans(F.col("_text")))
    found = found.withColumn("_marks", F.when(F.size("_base") > FEW, marked(F.col("_base"))))
    found = written(found.select(*key, F.concat("_base", candidate_spans(F.col("_text"), F.col("_base"), F.col("_marks"))).alias("spans")))
    seen = found.select(F.explode("spans").alias("s")).where(F.col("s.kind") >= len(BASE)).groupBy(F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).agg(F.count("*").alias("n"))
    counted = [(tuple(r.votes), tuple(r.features), r.n) for r in seen.collect()]
    by_vote: dict[tuple[int, ...], int] = {}
    for v, _, n in sorted(counted):
        by_vote[v] = by_vote.get(v, 0) + n
    prior, table = reliabilities(sorted(by_vote.items()))
    bias, weights = fit_spans([(f, float(n), posterior(v, prior, table)) for v, f, n in sorted(counted)])
    level = lambda s, j: F.lit(weights[j])[s["features"][j]]

    def kept(s: Column) -> Column:
        score = F.lit(bias)
        for j in range(len(weights)):
            score = score + level(s, j)
        return F.when(s["kind"] < len(BASE), F.lit(True)).otherwise(score > math.log(threshold / (1 - threshold)))

    spans = F.transform(F.filter("spans", kept), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(*key, F.array_sort(spans).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (overlaps joined) replaced by its kind in angle brackets."""
    name = F.lit([f"<{k}>" for k in KINDS])

    def replaced(pages: Column) -> Column:
        def parts(far: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                return F.when(s["start"] >= far[i], F.concat(cut(pages, far[i], s["start"]), name[s["kind"]])).otherwise(F.lit(""))

            rest = cut(pages, F.greatest(F.element_at(far, -1), F.element_at(spans, -1)["end"]), F.length(text))
            return F.array_join(F.concat(F.transform(spans, part), F.array(rest)), "")

        return let(running(F.transform(spans, lambda s: s["end"]), _most), parts)

    return F.when(F.size(spans) == 0, text).otherwise(let(paged(text), replaced))
