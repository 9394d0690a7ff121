"""The operators applied to the driver's tables: one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import ann, fim, merkle, packing, pieces, quality, records, search, secrets, simhash, suffixes, toxicity, warc
from motifloom.llm.common import scratch_path, small_batches

#: Names of the vocabularies, found by public_tokenizers.path().
WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.duplicate_components(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.summary(spark, archive)


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.half_edited(table(spark, sf_dir, "documents"))


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "records")
    records.write(table(spark, sf_dir, "documents"), folder, vocabulary(WORDS), end=(1,))
    return records.read(records.index(spark, folder), folder, ids=False)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary(WORDS), 4096, end=(2,))
    return packing.pack(cut, 4096).drop("doc_key")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.removals(table(spark, sf_dir, "documents"), words=51)
    size = lambda spans: F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    count = lambda spans: F.when(F.col(spans).isNull(), 0).otherwise(F.size(spans)).cast("long")
    return found.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), size("spans").alias("n_removed"), count("spans").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # besides: repeated runs of over 50 words, which may be shorter than 400 bytes; nothing is removed for them
        size("spans_words").alias("passage_bytes"), count("spans_words").alias("n_passages"),
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.written_out(F.filter("spans", lambda x: x["kind"] < len(secrets.BASE)))
    return found.select("doc_id", *secrets.counts(F.col("spans")), F.sha2(base, 256).alias("base_sha256"), secrets.written_out(F.col("spans")).alias("spans"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_simhash, op3_warc, op4_merkle, op5_records, op6_pieces, op7_quality, op8_packing, op9_neighbours, op10_suffixes, op11_search, op12_secrets, op13_fim, pipeline)
    return {f.__name__: f for f in found}


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, payload_bytes,
  translate(upper(to_base(CAST('0x' || substr(hex, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(hex, 11, 10) AS BIGINT), 32, 8)
    || to_base(CAST('0x' || substr(hex, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(hex, 31, 10) AS BIGINT), 32, 8)),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (html)
"""


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{search.UPPER}', '{search.LOWER}'), '{search.TERM}') AS ts FROM documents),
c AS (SELECT row_number() OVER () AS row, doc_id, ts, len(ts) AS n FROM d),
s AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS total FROM c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')) AS term FROM benchmark),
o AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM o GROUP BY term), s),
x AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN o USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def _spans_sql(name: str, pattern: str) -> str:
    """Start, end and text of all matches of a pattern, by the lengths of what lies between them."""
    return f"""{name}0 AS (SELECT row, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM t),
{name}1 AS (SELECT row, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS x, unnest(g[:len(m)]) AS gap FROM {name}0 WHERE len(m) > 0),
{name} AS (SELECT row, x, (sum(length(gap) + length(x)) OVER (PARTITION BY row ORDER BY i) - length(x))::BIGINT AS s FROM {name}1)"""


def _entropy_sql() -> str:
    """Candidate strings with the starts of their first and last windows of high entropy; each window's counts anew."""
    parts = "[" + ", ".join(map(str, secrets._parts(secrets.WINDOW))) + "]"
    fold = "CASE " + " ".join(f"WHEN regexp_matches(x, '{c.pattern}') THEN {'lower(x)' if c.folded else 'x'}" for c in secrets.CLASSES) + " END"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(x, '{c.pattern}') THEN {len(secrets.BASE) + k}" for k, c in enumerate(secrets.CLASSES)) + " END"
    most = "CASE kind " + " ".join(f"WHEN {len(secrets.BASE) + k} THEN {secrets._most(c.least, secrets.WINDOW)}" for k, c in enumerate(secrets.CLASSES)) + " END"
    free = " AND ".join(f"NOT regexp_matches(x, '{a}')" for a in secrets.ALLOWED)
    return f"""{_spans_sql('runs', secrets.CANDIDATE)},
cand AS (SELECT row_number() OVER () AS c, row, s, {kind} AS kind, {fold} AS y FROM runs WHERE {free}),
win AS (SELECT c, row, s, kind, i, substr(y, i + 1, {secrets.WINDOW}) AS z FROM (SELECT *, unnest(range(0, length(y) - {secrets.WINDOW} + 1)) AS i FROM cand)),
cnt AS (SELECT c, row, s, kind, i, ch, count(*) AS n FROM (SELECT *, unnest(string_split(z, '')) AS ch FROM win) GROUP BY ALL),
hot AS (SELECT c, row, s, kind, i FROM cnt GROUP BY ALL HAVING sum({parts}[n + 1]) <= {most}),
ent AS (SELECT row, kind, s + min(i) AS a, s + max(i) + {secrets.WINDOW} AS b FROM hot GROUP BY c, row, kind, s)"""


_ASSIGN = secrets.ASSIGN.replace("'", "''")
OP12_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
{_spans_sql('assigns', _ASSIGN)}, {_spans_sql('accesses', 'AKIA[A-Z0-9]+')}, {_spans_sql('hexes', '[0-9a-f]+')}, {_entropy_sql()},
every AS (
  SELECT row, 0 AS kind, s AS a, s + length(x) AS b FROM assigns WHERE length(regexp_extract(x, '{_ASSIGN}', 2)) >= 6
  UNION ALL SELECT row, 1, s, s + length(x) FROM accesses WHERE length(x) >= 20
  UNION ALL SELECT row, 2, s, s + length(x) FROM hexes WHERE length(x) >= 24
  UNION ALL SELECT row, kind, a, b FROM ent
), named AS (SELECT *, ['{"', '".join(secrets.KINDS)}'][kind + 1] || ':' || a || ':' || b AS w FROM every),
g AS (SELECT row, {', '.join(f'count(*) FILTER (kind = {k}) AS n_{name}' for k, name in enumerate(secrets.KINDS))},
  string_agg(w, ',' ORDER BY a, kind) FILTER (kind < {len(secrets.BASE)}) AS base, string_agg(w, ',' ORDER BY a, kind) AS spans FROM named GROUP BY row)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0)::BIGINT AS n_{name}' for name in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (row)
"""

_DRAW = "('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {}, 8))::BIGINT"
OP13_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, {', '.join(f'{_DRAW.format(1 + 8 * k)} AS h{k + 1}' for k in range(4))} FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op11_search": OP11_SQL, "op12_secrets": OP12_SQL, "op13_fim": OP13_SQL}
