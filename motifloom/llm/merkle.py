"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces, in DataFrame functions alone.

A text's lines are its paragraphs; a section ends after a paragraph whose digest is 0 modulo 4, so
sections move with their content. Paragraphs are cut into pieces at sentence ends, or every 80
characters. Every node's digest is taken of its children's digests, in order; the root also takes
the SHA-256 of the text, so that equal roots mean equal texts. Fingerprints hold 32 bits of the
digests of sections, paragraphs and pieces; likeness is read from those alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.llm.common import columns_of, id_ranges, shuffles

#: Characters that a piece of a paragraph has at most, unless signs of a sentence end follow.
PIECE = 80
#: Ranges of ids at most; their first ids are broadcast.
RANGES = 20_000
LEVELS = ("root", "sections", "paragraphs", "pieces")


def with_tree(df: DataFrame, text: str, to: str, piece: int = PIECE) -> DataFrame:
    """df with the tree of df[text] (null: as empty) in the columns {to}_root (string), {to}_sections, {to}_paragraphs, {to}_pieces (arrays of long, 32 bits
    of each digest) and {to}_counts (paragraphs of each section).

    Nodes are computed level by level, each from the level below, so that none is computed twice.
    """
    leaves, wide = F.col(f"{to}_leaves"), F.col(f"{to}_wide")
    short = lambda xs: F.transform(xs, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    pattern = F.lit(rf"[^.!?]{{1,{piece}}}[.!?]*|[.!?]+")
    df = df.withColumn(f"{to}_leaves", F.transform(lines, lambda p: F.transform(F.regexp_extract_all(p, pattern, F.lit(0)), lambda s: F.xxhash64(s))))
    df = df.withColumn(f"{to}_wide", F.transform(leaves, lambda p: F.xxhash64(F.concat_ws(",", F.transform(p, lambda x: x.cast("string"))))))
    df = df.withColumn(f"{to}_pieces", short(F.flatten(leaves))).drop(f"{to}_leaves")
    ended = F.transform(wide, lambda p: F.concat(F.hex(p), F.when(F.pmod(p, F.lit(4)) == 0, F.lit("|")).otherwise(F.lit(","))))
    df = df.withColumn(f"{to}_parts", F.filter(F.split(F.concat_ws("", ended), "\\|"), lambda s: s != ""))
    df = df.withColumn(f"{to}_counts", F.transform(F.col(f"{to}_parts"), lambda s: F.size(F.filter(F.split(s, ","), lambda x: x != ""))))
    df = df.withColumn(f"{to}_tops", F.transform(F.col(f"{to}_parts"), lambda s: F.xxhash64(s))).drop(f"{to}_parts")
    top = F.concat_ws(",", F.transform(F.col(f"{to}_tops"), lambda x: F.hex(x)))
    df = df.withColumn(f"{to}_root", F.sha2(F.concat_ws("/", top, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 256))
    df = df.withColumn(f"{to}_sections", short(F.col(f"{to}_tops"))).withColumn(f"{to}_paragraphs", short(wide))
    return df.drop(f"{to}_tops", f"{to}_wide")


def fingerprint(of: str) -> Column:
    """The tree of with_tree(to=of) as a string: root, then after colons 8 hexadecimal digits of each section, paragraph and piece."""
    digits = lambda xs: F.concat_ws("", F.transform(xs, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))
    return F.concat_ws(":", F.col(f"{of}_root"), *[digits(F.col(f"{of}_{level}")) for level in LEVELS[1:]])


def likeness(a: str, b: str) -> Column:
    """0 to 1: 1 exactly for equal roots; else the share of different pieces that both fingerprints have, under 1."""
    x, y = F.col(f"{a}_pieces"), F.col(f"{b}_pieces")
    either = F.size(F.array_union(x, y)).cast("double")
    share = F.when(either > 0, F.size(F.array_intersect(x, y)).cast("double") / either).otherwise(F.lit(0.0))
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.lit(1.0)).otherwise(F.least(share, F.lit(0.999999)))


def _same(x: Column, y: Column) -> Column:
    """How many first elements two arrays have in common."""
    differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int")
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(x), F.size(y)))


def with_edits(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """df with array<int> `to`: the numbers (from 0) of the paragraphs of tree a that an edit to tree b replaced or took out.

    Branches are descended from the roots: equal roots have none; sections that both trees begin or
    end with are passed over; of the paragraphs under the others, those that both begin or end with.
    So one edit is located to the paragraph, several as the range from the first to the last. A paragraph that
    moved counts where it was; where paragraphs were only added, none does.
    """
    at = lambda name: F.col(f"{to}_{name}")
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
    x, y, cx, cy = (F.col(f"{t}_{level}") for level in ("sections", "counts") for t in (a, b))
    df = df.withColumn(f"{to}_p", _same(x, y))
    df = df.withColumn(f"{to}_q", F.least(_same(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - at("p")))
    df = df.withColumn(f"{to}_first", size(F.slice(cx, F.lit(1), at("p"))))
    under = lambda t, c: F.slice(F.col(f"{t}_paragraphs"), at("first") + 1, size(F.slice(c, at("p") + 1, F.size(c) - at("p") - at("q"))))
    df = df.withColumn(f"{to}_x", under(a, cx)).withColumn(f"{to}_y", under(b, cy))
    df = df.withColumn(f"{to}_p", _same(at("x"), at("y")))
    df = df.withColumn(f"{to}_q", F.least(_same(F.reverse(at("x")), F.reverse(at("y"))), F.least(F.size(at("x")), F.size(at("y"))) - at("p")))
    n = F.size(at("x")) - at("p") - at("q")
    none = (F.col(f"{a}_root") == F.col(f"{b}_root")) | (n <= 0)
    start = at("first") + at("p")
    found = F.when(none, F.array().cast("array<int>")).otherwise(F.sequence(start, start + F.greatest(n, F.lit(1)) - 1))
    return df.withColumn(to, found).drop(*[f"{to}_{c}" for c in ("p", "q", "first", "x", "y")])


def beside_next(docs: DataFrame, first: str, per_range: int = 1000) -> DataFrame:
    """docs with `next`: a struct of the columns of the row with the next smaller doc_id; after the smallest, the largest.

    Ids are cut into ranges of about per_range rows (at most RANGES ranges, so that the table of
    their first ids is bounded and may be broadcast), and a window runs over each. The first row of
    each range goes along to the end of the range before it. So the rows are shuffled once, and no
    task needs the order of all ids. Beyond RANGES x per_range rows ranges hold more rows; the window looks one row
    ahead and its sort spills, so a task streams its range (of 100 TB, 5 GB) and holds no more. Null ids come last; equal ids are in the order of the column `first`.
    """
    block, rows = id_ranges(docs, "doc_id", per_range, RANGES)
    block = -block
    heads = docs.select("doc_id", block.alias("block")).groupBy("block").agg(F.max("doc_id").alias("head"))
    whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # over RANGES rows at most
    before = F.coalesce(F.lag("block").over(W.orderBy("block")), F.last("block").over(whole))
    heads = heads.select("head", before.alias("before"))
    found = docs.withColumn("_block", block).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    place = lambda at, guest: F.struct(at.cast("long").alias("at"), F.lit(guest).alias("guest"))
    own, away = place(F.col("_block"), False), place(F.col("before"), True)
    placed = found.withColumn("_place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, away))))
    placed = placed.repartition(shuffles(docs.sparkSession, rows, per_range), "_place.at")
    order = W.partitionBy("_place.at").orderBy(F.col("_place.guest"), F.col("doc_id").desc_nulls_last(), F.col(first))
    led = placed.withColumn("next", F.lead(F.struct(*docs.columns)).over(order))
    return led.where("not _place.guest").select(*docs.columns, "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, root, fingerprint) of every row; null texts as empty; equal texts have equal fingerprints."""
    own = with_tree(columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]), "text", "own")
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return own.select("doc_id", n_chars.alias("n_chars"), F.col("own_root").alias("root"), fingerprint("own").alias("fingerprint"))


def compare(left: DataFrame, right: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, likeness, edited array<int>) of the texts that two versions of a table have for one id.

    Where a version has several rows for an id, the one with the smallest text stands for it. Null ids and those of one version only are left out.
    """
    one = lambda df: columns_of(df, [(id_col, "doc_id"), (text_col, "text")]).groupBy("doc_id").agg(F.min("text").alias("text"))
    a, b = (with_tree(one(df), "text", to).drop("text") for df, to in ((left, "a"), (right, "b")))
    return with_edits(a.join(b, "doc_id"), "a", "b", "edited").select("doc_id", likeness("a", "b").alias("likeness"), "edited")


def half_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text, and its edited text: its last half (rounded down) replaced by as much of the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and edited_paragraphs, the paragraphs that the edit changed. The next document is that of the
    next smaller id; after the smallest comes the largest. Only texts are shuffled and go along; trees are made where they are read.
    """
    own = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]).withColumn("text", F.coalesce("text", F.lit("")))
    led = beside_next(own, "text").select("doc_id", "text", F.col("next.text").alias("next_text"))
    led = led.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = with_tree(led.withColumn("edited", edited), "text", "own").drop("text")
    done = with_tree(done, "next_text", "next").drop("next_text", "next_sections", "next_paragraphs", "next_counts")
    done = with_edits(with_tree(done, "edited", "edited"), "own", "edited", "changed")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"), F.col("changed").alias("edited_paragraphs"),
    )
