"""Secrets in texts by DataFrame functions only: assignments, access keys and hexadecimal runs, and strings whose sliding-window entropy is high for their character class."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in their order. Runs of digits or capitals end only where they must, so that too short ones
# need not be matched first; assignments are matched whatever the length of their secret part, as a dropped one still uses up its text.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

#: A string whose windows are measured: this many characters at least, of these classes' characters alone.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"


@dataclass(frozen=True)
class CharClass:
    """Characters that strings of a class are made of (case folded or not), and the entropy in thousandths of a bit a character that a window must reach."""

    name: str
    pattern: str
    alphabet: str
    folded: bool
    least: int


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The first class that a whole string fits is its class. A window of random hexadecimal digits has 3.4 bits on average, of random base64 4.0.
CLASSES = (
    CharClass("entropy_hex", "^[0-9A-Fa-f]+$", "0123456789abcdef", True, 2950),
    CharClass("entropy_base64", "^[A-Za-z0-9+/_=-]+$", "0123456789" + _LETTERS.upper() + _LETTERS + "+/_=-", False, 3650),
)
#: Strings that are no secrets, however mixed: without digits or without letters, UUIDs, names of words and numbers joined by marks, counted-up alphabets, stand-ins.
ALLOWED = (
    "^[^0-9]+$",
    "^[^A-Za-z]+$",
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "^/?([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([-_/=+]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/=+]*$",
    "(?i)0123456789abcdef|abcdefghijklmnop|123456789012|example|placeholder|changeme|x{6}",
    "^(da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)
_CHUNK = 256


def _parts(window: int) -> list[int]:
    """c * log2(c) in thousandths, for counts up to the window's size."""
    return [0, *(round(1000 * c * math.log2(c)) for c in range(1, window + 1))]


def _most(least: int, window: int) -> int:
    """A window's entropy is at least `least` where its sum of parts is at most this."""
    return math.floor(window * (1000 * math.log2(window) - least))


def running(sizes: Column) -> Column:
    """What the sizes before each place sum to. Chunks first, so that an array of n takes about n * sqrt(n) steps and not n * n."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda c: F.slice(sizes, c * _CHUNK + 1, _CHUNK))
    none = F.array().cast("array<int>")
    step = lambda acc, x: F.struct(F.array_append(acc["made"], acc["sum"]).alias("made"), (acc["sum"] + x).alias("sum"))
    from_ = lambda array, at: F.aggregate(array, F.struct(none.alias("made"), at.alias("sum")), step)["made"]
    total = lambda array: F.aggregate(array, F.lit(0), lambda a, x: a + x)
    return F.flatten(F.zip_with(chunks, from_(F.transform(chunks, total), F.lit(0)), from_))


def _each(df: DataFrame, name: str, pattern: str, text: str) -> DataFrame:
    """With the column `name`: start, end (code points, end exclusive) and text of all matches, leftmost first, none overlapping."""
    df = df.withColumn("_found", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size("_found") > 0
    df = df.withColumn("_gap", F.when(some, F.transform(F.split(text, pattern, -1), F.length)))
    df = df.withColumn("_before", F.when(some, running(F.zip_with(F.slice("_gap", 1, F.size("_found")), "_found", lambda gap, x: gap + F.length(x)))))
    placed = F.zip_with(F.zip_with(F.slice("_gap", 1, F.size("_found")), "_before", lambda a, b: a + b), "_found",
                        lambda at, x: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("text")))
    return df.withColumn(name, F.coalesce(placed, F.array().cast("array<struct<start:int,end:int,text:string>>"))).drop("_found", "_gap", "_before")


def hot_windows(text: Column, of: CharClass, window: int = WINDOW) -> Column:
    """first and last: the starts of the first and last windows that reach the class's entropy, or nulls; peak: the highest entropy of a window.

    Windows slide by one character. Counts of characters are kept, and a step changes two of them: the sum of
    c * log2(c) is mended for the character that leaves and for the one that enters.
    """
    part = F.array(*map(F.lit, _parts(window)))
    codes = F.transform(F.split(F.lower(text) if of.folded else text, ""), lambda c: F.instr(F.lit(of.alphabet), c) - 1)
    leaves = F.concat(F.array_repeat(F.lit(-1), window), codes)
    moves = F.arrays_zip(codes.alias("enter"), F.slice(leaves, 1, F.size(codes)).alias("leave"))

    def step(acc: Column, move: Column) -> Column:
        enter, leave = move["enter"], move["leave"]
        less, more = F.coalesce(F.get(acc["counts"], leave), F.lit(0)), F.get(acc["counts"], enter)
        moved = acc["sum"] - F.when(leave >= 0, F.get(part, less) - F.get(part, less - 1)).otherwise(0) + F.get(part, more + 1) - F.get(part, more)
        total = F.when(enter == leave, acc["sum"]).otherwise(moved)
        counts = F.when(enter == leave, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda n, k: n + F.when(k == enter, 1).when(k == leave, -1).otherwise(0))
        )
        full = acc["at"] + 1 >= window
        hot = full & (total <= _most(of.least, window))
        start = acc["at"] + 1 - window
        return F.struct(
            (acc["at"] + 1).alias("at"), counts.alias("counts"), total.alias("sum"),
            F.when(hot & acc["first"].isNull(), start).otherwise(acc["first"]).alias("first"), F.when(hot, start).otherwise(acc["last"]).alias("last"),
            F.when(full, F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"),
        )

    null = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"), F.lit(0).alias("sum"), null.alias("first"), null.alias("last"), null.alias("low"))
    done = F.aggregate(moves, zero, step)
    return F.struct(done["first"].alias("first"), done["last"].alias("last"), (math.log2(window) - done["low"] / (1000.0 * window)).alias("peak"))


def allowed(text: Column) -> Column:
    """Whether a string is on the allow list."""
    found = F.lit(False)
    for pattern in ALLOWED:
        found = found | text.rlike(pattern)
    return found


def _entropic(runs: Column) -> Column:
    """start, end, kind number of the strings with high windows: from their first to their last high window."""

    def one(run: Column) -> Column:
        made = F.when(allowed(run["text"]), F.lit(None))
        for k, c in enumerate(CLASSES):
            made = made.when(run["text"].rlike(c.pattern), F.struct(F.lit(len(BASE) + k).alias("kind"), hot_windows(run["text"], c).alias("hot")))
        return F.struct(run["start"].alias("start"), made.alias("made"))

    hot = F.filter(F.transform(runs, one), lambda x: x["made"]["hot"]["first"].isNotNull())
    at = lambda x, name: x["start"] + x["made"]["hot"][name]
    return F.transform(hot, lambda x: F.struct(at(x, "first").alias("start"), x["made"]["kind"].alias("kind"), (at(x, "last") + WINDOW).alias("end")))


KINDS = (*(b[0] for b in BASE), *(c.name for c in CLASSES))


def _base(kind: int) -> Column:
    """start, kind number, end of a base kind's matches with a long enough secret part."""
    name, pattern, group, least = BASE[kind]
    long = F.filter(f"_{name}", lambda x: F.length(F.regexp_extract(x["text"], pattern, group) if group else x["text"]) >= least)
    return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and spans, an array of (start, kind, end) by start, then kind as in KINDS; places are code points, ends exclusive.

    Base kinds are found by their patterns, whole matches being the spans; matches whose secret part is too short are
    dropped after they were matched. Besides, strings of WINDOW characters or more of one class are measured, unless
    they are on the allow list; base spans are never suppressed, and a string may have spans of several kinds.
    One row a row given, repeats alike, whatever ids they have; empty texts have no spans. No row depends on another,
    and nothing is shuffled.
    """
    df = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    for name, pattern, _, _ in BASE:
        df = _each(df, f"_{name}", pattern, "text")
    df = _each(df, "_runs", CANDIDATE, "text")
    spans = [_base(k) for k in range(len(BASE))]
    df = df.withColumn("spans", F.array_sort(F.concat(*spans, _entropic(F.col("_runs")))))
    return df.select("doc_id", "text", "spans")


def written_out(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "*") -> Column:
    """The text with every character of a span replaced."""
    cover = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.array_append(acc["out"], F.concat(F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.repeat(F.lit(mark), F.greatest(x["end"] - F.greatest(acc["at"], x["start"]), F.lit(0))))).alias("out"),
        ),
    )
    return F.concat(F.array_join(cover["out"], ""), F.substr(text, cover["at"] + 1, F.length(text)))


def counts(spans: Column) -> list[Column]:
    """Number of spans of each kind, as n_<kind>."""
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
