"""Fill-in-middle: texts are cut into units, dealt to prefix, middle and suffix, and put together in another order, whole batches at a time in pyarrow.compute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are cut into units at a time (a longer text alone); their units take some 10 times as much.
BYTES = 4 << 20
#: No byte of UTF-8, so that it can part units in any text.
_CUT, _NONE = b"\xff", pa.scalar(b"", pa.large_binary())


def draws(key: Column, seed: int = 1, many: int = 4) -> list[Column]:
    """Whole numbers of 32 bits from the SHA-256 of "seed:key"; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(many)]


def _offsets(sizes):
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _mod(a, b):
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units(texts) -> tuple:
    """All units of the texts in one array, the text of each, and each text's number of units. A unit is a run of A-Z and a-z, or one other character."""
    parted = pc.replace_substring_regex(texts, pattern="([^A-Za-z])", replacement=_CUT + rb"\1" + _CUT)
    lists = pc.split_pattern(parted.cast(pa.large_binary()), _CUT)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(some), parent.filter(some)
    return flat, parent, pa.array(np.bincount(parent.to_numpy(), minlength=len(texts)))


def rearranged(texts, form, first, second):
    """A struct array of n, prefix_chars, middle_chars and output, for texts and two draws each. Pieces of plain texts count as null."""
    flat, parent, n = units(texts)
    one, other = (_mod(h, pc.add(n, 1)) for h in (first, second))
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    start = pc.subtract(pc.cumulative_sum(n), n)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), start.take(parent))
    before, ahead = pc.less(ordinal, low.take(parent)), pc.less(ordinal, high.take(parent))
    roles = ((before, low), (pc.and_not(ahead, before), pc.subtract(high, low)), (pc.invert(ahead), pc.subtract(n, high)))
    prefix, middle, suffix = (
        pc.binary_join(pa.LargeListArray.from_arrays(_offsets(size.to_numpy()), flat.filter(role)), _NONE).cast(pa.large_string()) for role, size in roles
    )
    join = lambda *parts: pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], pa.scalar("", pa.large_string()))
    psm, spm = join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    plain = pc.equal(form, "plain")
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return pa.StructArray.from_arrays([n, *chars, output.cast(pa.string())], ["n", "prefix_chars", "middle_chars", "output"])


def _slices(texts) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BYTES of text, one row at least."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
        yield at, to - at
        at = to


def _transform():
    @F.arrow_udf("n long, prefix_chars long, middle_chars long, output string")
    def run(texts: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = [rearranged(*(x.slice(at, n) for x in (texts, form, first, second))) for at, n in _slices(texts)]
        return pa.concat_arrays(parts) if len(parts) != 1 else parts[0]

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null: empty), form, n (units), prefix_chars, middle_chars (null if plain), output.

    A text is cut at two units drawn from its id: what lies before the first is the prefix, between them the middle,
    after them the suffix. Of 100 texts `rate` are rearranged, and of 100 of these `spm` with the suffix first.
    Texts that are empty or hold a mark stay plain, so that every output can be undone (restored()). Draws depend on
    seed and id alone: repeated rows have equal results, texts of a null id are drawn as for an empty one.
    """
    one, two, three, four = draws(docs[doc_id], seed)
    given = F.coalesce(docs[text], F.lit(""))
    marked = (given == "") | given.contains(PREFIX) | given.contains(SUFFIX) | given.contains(MIDDLE)
    form = F.when(marked | (F.pmod(three, F.lit(100)) >= rate), "plain").when(F.pmod(four, F.lit(100)) < spm, "spm").otherwise("psm")
    drawn = docs.select(docs[doc_id].alias("doc_id"), given.alias("text"), form.alias("form"), one.alias("one"), two.alias("two"))
    made = drawn.withColumn("made", _transform()("text", "form", "one", "two"))
    return made.select("doc_id", "text", "form", "made.n", "made.prefix_chars", "made.middle_chars", "made.output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone. Each mark is in a rearranged output once."""
    parts = F.split(output, "<[PSM]>", 4)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
