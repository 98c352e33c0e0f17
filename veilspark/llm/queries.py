"""The registered queries of the package and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, conversations, decontaminate, fertility, language, line_dedup, mixing, negatives, ngram_join, token_counts, tokens_orc, toxicity, vectors
from veilspark.llm.shared import WORD, held_out, new_folder, stored


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out(0, 5)))
    marks = language.identify(docs, model)
    return marks.select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens-orc")
    tokens_orc.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    return tokens_orc.token_report(spark, path)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    second = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs, path = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    return fertility.rate_by_norms(docs, path, second=second)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~held_out(2, 4)))
    return toxicity.score(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "score", "predicted")


#: Two tokenizer versions for the rollup: words, and runs of letters or digits with every other sign alone.
SIGNS = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
#: Parts in which the copies of a text are joined.
COPY_PARTS = 16


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: counts by words go in, later exact copies go out, the rest moves to another tokenizer.

    The second batch is committed twice, which must change nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    count = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    counted = docs.select(
        "doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("copy"), count(WORD).alias("words"), count(SIGNS).alias("signs")
    )
    counted = stored(counted, "token-counts")
    # texts that stand once have no copies; a text that stands very often is joined in parts
    firsts = counted.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))))
    marked = counted.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_PARTS)).cast("int")).join(firsts, ["copy", "part"], "left")
    marked = marked.withColumn("later", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    none = F.lit(None).cast("long")

    def changes(rows: DataFrame, op: str, tokenizer: str, old, new) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), old.alias("old_tokens"), new.alias("new_tokens"))

    store = new_folder(spark, "rollup")
    token_counts.commit(changes(counted, "insert", "words", none, F.col("words")), store, "1-load")
    copies = changes(marked.filter("later"), "delete", "words", F.col("words"), none)
    for _ in range(2):
        token_counts.commit(copies, store, "2-copies")
    rest = marked.filter("not later")
    moved = changes(rest, "delete", "words", F.col("words"), none).union(changes(rest, "insert", "signs", none, F.col("signs")))
    token_counts.commit(moved, store, "3-retokenize")
    return token_counts.ledger(spark, store).select("batch", "source", "lang", "tokenizer", "docs", "tokens")


def op10_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer after counts by words go in and a batch, committed twice, revises them all to counts by signs."""
    docs = table(spark, sf_dir, "documents")
    count = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    counted = stored(docs.select("source", "lang", count(WORD).alias("words"), count(SIGNS).alias("signs")), "token-totals")
    both = counted.select("source", "lang", F.lit("current").alias("tokenizer"), F.col("words").alias("old_tokens"), F.col("signs").alias("new_tokens"))
    store = new_folder(spark, "rollup")
    first = both.withColumn("new_tokens", F.col("old_tokens")).withColumn("old_tokens", F.lit(None).cast("long"))
    token_counts.commit(first.withColumn("op", F.lit("insert")), store, "1-load")
    for _ in range(2):
        token_counts.commit(both.withColumn("op", F.lit("revise")), store, "2-revise")
    return token_counts.totals(spark, store)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", F.col("leak.n_words").cast("long").alias("n_words"), F.col("leak.n_hit").cast("long").alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vec"))
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations as the contract says, then repairs them."""
    rows = table(spark, sf_dir, "conversations")
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    damaged = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return conversations.report(conversations.repaired(damaged, F.col("copies")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_language_id, op3_embedding_dedup, op4_line_dedup, op5_ngram_jaccard,
        op6_token_orc, op7_byte_bpe, op8_fertility, op9_toxicity, op10_token_counts,
        op10_token_totals, op11_decontaminate, op12_hard_negatives, op13_repair_conversations,
    )
}

_LINES = f"""
lines AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) - n AS start,
         sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos
  FROM (SELECT doc_id, line, md5(content) AS h, len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL))
  WHERE n > 0),
"""
ORACLE = {
    # every occurrence of a fingerprint against all earlier ones, each pair followed both ways to its ends
    "op4_line_dedup": f"""
WITH RECURSIVE {_LINES}
parts AS (
  SELECT doc_id, pos, start, total, list(upper(h)) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {line_dedup.GRAM - 1} FOLLOWING) AS hs
  FROM lines),
grams AS (
  SELECT doc_id, pos, start, total, md5(array_to_string(hs, '')) AS g FROM parts WHERE start + {line_dedup.GRAM} <= total),
windows AS (
  SELECT start, total, doc_id,
         min({{'g': g, 'pos': pos}}) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {line_dedup.RUN - line_dedup.GRAM} FOLLOWING) AS least
  FROM grams),
marks AS (SELECT DISTINCT doc_id, least.pos AS pos, least.g AS g FROM windows WHERE start + {line_dedup.RUN} <= total),
seeds AS (
  SELECT DISTINCT m.doc_id, m.pos, o.doc_id AS other, o.pos - m.pos AS shift
  FROM marks m JOIN marks o ON o.g = m.g AND (o.doc_id < m.doc_id OR o.doc_id = m.doc_id AND o.pos < m.pos)),
equal AS (
  SELECT d.doc_id, d.other, d.shift, mine.pos, mine.line,
         mine.pos - row_number() OVER (PARTITION BY d.doc_id, d.other, d.shift ORDER BY mine.pos) AS island
  FROM (SELECT DISTINCT doc_id, other, shift FROM seeds) d
  JOIN lines mine ON mine.doc_id = d.doc_id
  JOIN lines theirs ON theirs.doc_id = d.other AND theirs.pos = mine.pos + d.shift AND theirs.h = mine.h),
gone AS (
  SELECT DISTINCT e.doc_id, e.line FROM equal e
  JOIN (SELECT DISTINCT doc_id, other, shift, island FROM seeds JOIN equal USING (doc_id, other, shift, pos)) USING (doc_id, other, shift, island)),
kept AS (
  SELECT l.doc_id, string_agg(content, chr(10) ORDER BY line) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL) l
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.line = l.line) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS BIGINT) AS n_deleted
FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op10_token_counts": r"""
WITH counted AS (
  SELECT doc_id, source, lang, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS later,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
         coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')), 0) AS signs
  FROM documents),
changes AS (
  SELECT '1-load' AS batch, source, lang, 'words' AS tokenizer, 1 AS d, words AS t FROM counted
  UNION ALL SELECT '2-copies', source, lang, 'words', -1, -words FROM counted WHERE later
  UNION ALL SELECT '3-retokenize', source, lang, 'words', -1, -words FROM counted WHERE later IS NOT TRUE
  UNION ALL SELECT '3-retokenize', source, lang, 'signs', 1, signs FROM counted WHERE later IS NOT TRUE)
SELECT batch, source, lang, tokenizer, CAST(sum(d) AS BIGINT) AS docs, CAST(sum(t) AS BIGINT) AS tokens
FROM changes GROUP BY ALL""",
    "op10_token_totals": r"""
SELECT source, lang, 'current' AS tokenizer, CAST(count(*) AS BIGINT) AS docs,
       CAST(sum(coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')), 0)) AS BIGINT) AS tokens
FROM documents GROUP BY ALL""",
    "op11_decontaminate": r"""
WITH items AS (
  SELECT rowid AS item, item_id, ws, least(10, len(ws)) AS k FROM (
    SELECT row_number() OVER () AS rowid, item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark) WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM items)),
docs AS (
  SELECT row_number() OVER () AS d, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
places AS (
  SELECT d, p, k, array_to_string(ws[p : p + k - 1], ' ') AS gram
  FROM (SELECT d, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM docs, (SELECT DISTINCT k FROM windows))),
found AS (SELECT d, p, k, item_id FROM places JOIN windows USING (k, gram)),
hits AS (SELECT d, count(DISTINCT w) AS n FROM (SELECT d, unnest(generate_series(p, p + k - 1)) AS w FROM (SELECT DISTINCT d, p, k FROM found)) GROUP BY d),
named AS (
  SELECT d, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT d, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits h USING (d) LEFT JOIN named i USING (d)""",
    "op12_hard_negatives": """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
  FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10""",
}
