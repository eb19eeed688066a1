"""Secret scans: fixed patterns, and sliding-window entropy per character class. DataFrame functions only.

Spans are found without Python: the matches of a pattern and the pieces between them alternate, so the running sum of
their lengths gives code-point positions. Patterns:

    assign  a password, secret, token or key name, an equals sign or colon, and a value of 12 characters or more
    access  AKIA and upper-case letters or digits, 18 characters or more
    hex     16 or more of 0-9a-f

The method adds ``entropy``: candidates are runs of 20 or more of CANDIDATE's characters in what the spans above leave
of a text. A window of WINDOW characters slides over a candidate; the count of the character that comes in goes up by
one, that of the one that goes out down by one, and so the sum of c * log2 c over the counts changes by two differences.
A candidate is a span if its largest window entropy reaches the threshold of its class (hex: 16 symbols without case;
base64: 64 symbols and padding), unless the allow-list suppresses it. Stated example words are cut out of a candidate
first, and what they leave is judged.

Running sums are folded in blocks of BLOCK places, as a fold that appends to one long array copies it at every step.

Defined cases: null text is empty and has no spans; a text of any length, with any number of matches, is scanned whole;
repeated rows are scanned alike; an empty table gives an empty result; further columns are ignored (`redact` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, restored, table

#: The base patterns: fixed by contract. The first has its value in group 2.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Symbols of each class and the entropy, in bits a character, from which a window counts.
CLASSES = {
    "hex": (r"^[0-9A-Fa-f]+$", "0123456789abcdef", 3.0),
    "base64": (r"^.", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.75),
}
#: Words of stated examples: they are no part of a secret.
EXAMPLES = r"(?i)example|placeholder|changeme|xxxxxx"
#: Candidates that one of these fits are no secrets: numbers and dates, UUIDs.
ALLOWED = (r"^[0-9+/_=-]*$", r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
#: Nor are words joined by signs, with a number of up to 8 digits at the end: these are what each run of letters must be.
NUMBER, LETTERS, WORD = r"[/_=-]?[0-9]{1,8}$", r"^[A-Za-z+/_=-]*$", r"^(?:[A-Z]*|[a-z]*(?:[A-Z][a-z]{2,}+)*+)$"

#: Places that a running fold handles at once.
BLOCK = 64
_SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column], size: Column) -> Column:
    """For each place the join, from zero on, of all values before it, and at the end that of all. Values are ints, size their number."""

    def fold(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x)))

    def blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), join))
        whole = let(fold(totals, F.lit(0)), lambda starts: F.transform(parts, lambda p, i: F.slice(fold(p, starts[i]), F.lit(1), F.size(p))))
        return F.concat(F.flatten(whole), F.array(F.aggregate(totals, F.lit(0), join)))

    cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(size == 0, F.array(F.lit(0))).when(size <= BLOCK, fold(values, F.lit(0))).otherwise(let(cut, blocks))


def matches(text: Column, pattern: str, kind: int, guard: Column | None = None) -> Column:
    """The spans of all leftmost, non-overlapping matches. guard: where it is false there can be none."""

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("match"), F.length(m).alias("n")))
        return let(steps, lambda x: F.zip_with(x, F.slice(running(F.transform(x, lambda s: s["gap"] + s["n"]), lambda a, b: a + b, F.size(x)), F.lit(1), F.size(x)), span))

    def span(step: Column, at: Column) -> Column:
        begin = at + step["gap"]
        return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + step["n"]).alias("end"), step["match"].alias("match"))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(pattern) if guard is None else guard & text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def without(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with what the spans (by start) cover replaced. mark: of the number of characters that a span covers and no earlier one does.

    The text is first cut before every BLOCK-th span, so that a cut never runs over all that precedes it.
    """

    def parts(reach: Column) -> Column:
        n = F.size(spans)

        def block(b: Column) -> Column:
            lo, last = b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1
            return let(F.substring(text, reach[lo] + 1, reach[last + 1] - reach[lo]), lambda piece: F.array_join(F.transform(F.sequence(lo, last), lambda i: one(piece, reach[lo], i)), ""))

        def one(piece: Column, base: Column, i: Column) -> Column:
            begin, end = F.greatest(spans[i]["start"], reach[i]), reach[i + 1]
            return F.concat(F.substring(piece, reach[i] - base + 1, begin - reach[i]), F.when(spans[i]["start"] >= reach[i], mark(end - begin)).otherwise(mark_more(end - begin)))

        head = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block), "")
        return F.concat(head, F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    mark_more = mark if mark is blank else lambda n: F.lit("")
    ends = F.transform(spans, lambda s: s["end"])
    return F.when(F.size(spans) == 0, text).otherwise(let(running(ends, lambda a, b: F.greatest(a, b), F.size(spans)), parts))


def blank(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def entropy(s: Column, symbols: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of the windows of s; 0 if it is shorter than one.

    The counts are a string with one character for each symbol, of which a step overwrites two.
    """
    places = F.transform(F.split(s, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(symbols), c)))
    places = F.filter(places, lambda p: p > 0)  # from 1
    part = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])  # c * log2 c
    zero = 65
    has = lambda counts, p: F.ascii(F.substring(counts, p, F.lit(1))) - zero
    put = lambda counts, p, n: F.overlay(counts, F.char(n + zero), p, F.lit(1))
    start = F.struct(F.lit(chr(zero) * len(symbols)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))

    def over(at: Column) -> Column:
        def enter(acc: Column, p: Column) -> Column:
            gone = F.get(at, acc["i"] - window)

            def leave(n: Column) -> Column:
                return F.struct((part[n - 1] - part[n]).alias("d"), put(acc["counts"], gone, n - 1).alias("counts"))

            same = F.struct(F.lit(0.0).alias("d"), acc["counts"].alias("counts"))
            return let(F.when(acc["i"] < window, same).otherwise(let(has(acc["counts"], gone), leave)), lambda x: let(has(x["counts"], p), lambda n: step(acc, x, p, n)))

        def step(acc: Column, left: Column, p: Column, n: Column) -> Column:
            total = acc["sum"] + left["d"] + part[n + 1] - part[n]
            best = F.when(acc["i"] + 1 >= window, F.greatest(acc["best"], math.log2(window) - total / window)).otherwise(acc["best"])
            return F.struct(put(left["counts"], p, n + 1).alias("counts"), total.alias("sum"), best.alias("best"), (acc["i"] + 1).alias("i"))

        return F.aggregate(at, start, enter, lambda acc: acc["best"])

    return let(places, over)


def allowed(s: Column) -> Column:
    """Whether a candidate is a number, a date, a UUID, or words joined by signs with a short number at the end."""
    plain = F.regexp_replace(s, NUMBER, "")
    words = plain.rlike(LETTERS) & F.forall(F.split(plain, "[^A-Za-z]+"), lambda w: w.rlike(WORD))
    return reduce(lambda a, b: a | b, [s.rlike(p) for p in ALLOWED]) | words


def secret_like(candidate: Column) -> Column:
    """Whether a candidate string, without words of examples, reaches the entropy of its class and is not allowed."""

    def judged(s: Column) -> Column:
        found = F.lit(False)
        for fits, symbols, least in reversed(CLASSES.values()):
            word = F.lower(s) if symbols.islower() or "a" in symbols and "A" not in symbols else s
            found = F.when(s.rlike(fits), entropy(word, symbols) >= least - 1e-9).otherwise(found)
        return F.when(allowed(s), F.lit(False)).otherwise(found)

    return let(F.regexp_replace(candidate, EXAMPLES, ""), judged)


def scan(df: DataFrame) -> DataFrame:
    """df with `_base` and `_spans`: the spans of the patterns and all spans, by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 0), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_VALUE)
    df = df.withColumn("_assign", assign).withColumn("_access", matches(text, ACCESS, 1, text.contains("AKIA"))).withColumn("_hex", matches(text, HEX, 2))
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_rest", without(text, F.col("_base"), blank))
    df = df.withColumn("_added", F.filter(matches(F.col("_rest"), CANDIDATE, 3), lambda c: secret_like(c["match"])))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", "_added")))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by a mark (overlapping spans by one), and n_chars to match if there is one."""
    names, own = df.columns, ("text", "n_chars")
    text = F.col("text").cast("string")
    out = scan(carried(df, *own)).withColumn("text", F.when(F.size("_spans") > 0, without(text, F.col("_spans"), lambda n: F.lit(mark))).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*restored(names, *own))


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", count("_assign").alias("n_assign"), count("_access").alias("n_access"), count("_hex").alias("n_hex"),
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"),
    )
