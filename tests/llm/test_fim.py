"""Fill-in-middle against plain loops, its own inverse, and over odd rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from motifloom.llm import fim

rng = random.Random(13)


def plain(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "a", "éa", "<P>", "x <M> y", "<<S<P", "<P <S <M> <", "\x00\n\r\n\x7f", "日本 text ☃ \U0001f600 é", "a" * 100_000, ".!" * 60_000, "\n" * 300]
TEXTS += ["".join(rng.choice(["ab", "C", " ", "\n", "<", "P", ">", "S>", "<M", "ñ", "9", "\U0001f600"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
ROWS = [(None if i == 40 else i // 2 * 3, t) for i, t in enumerate(TEXTS)]


def test_outputs_match_plain_loops_and_are_undone(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, n int, form string").repartition(3)
    for seed, rate, spm in ((1, 90, 20), (7, 100, 50), (1, 0, 20)):
        made = fim.fill_in_middle(df, seed, rate, spm).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr)
        assert got == sorted(((i, t or "", *plain(i, t, seed, rate, spm)) for i, t in ROWS), key=repr)
        assert made.where("back <> text or back is null").count() == 0
    assert {r[1] for r in (plain(i, t) for i, t in ROWS)} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.where("false")).count() == 0


def test_slices_hold_whole_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "BYTES", 10)
    texts = pa.array(["abc", "", "x" * 50, "yy", "z" * 9, "", "q"], pa.large_string())
    got = list(fim._slices(texts))
    assert [at for at, _ in got] == [0, *[at + n for at, n in got][:-1]] and sum(n for _, n in got) == len(texts)
    assert all(n == 1 or sum(len(texts[k].as_py()) for k in range(at, at + n)) <= 10 for at, n in got)
    flat, parent, n = fim.units(texts)
    assert flat.to_pylist() == [b"abc", b"x" * 50, b"yy", b"z" * 9, b"q"] and parent.to_pylist() == [0, 2, 3, 4, 6] and n.to_pylist() == [1, 0, 1, 1, 1, 0, 1]
