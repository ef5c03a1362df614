"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.llm import langid
from annotide.llm._common import documents
from annotide.llm.byte_bpe import decode_ids, encode_documents
from annotide.llm.fingerprints import fingerprint_documents
from annotide.llm.hard_negatives import hard_negatives
from annotide.llm.line_dedup import dedup_lines
from annotide.llm.mixing import poisson_mix
from annotide.llm.ngram_jaccard import near_duplicates
from annotide.llm.pii import find_personal_data
from annotide.llm.quality_rules import judge
from annotide.llm.secrets import find_secrets
from annotide.llm.sharding import shard_documents
from annotide.llm.spelling import corpus_runs, count_words, drop_letter, group_variants
from annotide.llm.token_counts import count_tokens


def op1_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard_documents(documents(spark, sf_dir), n_shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_cross_parsing_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = langid.identify(docs, langid.fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=5, threshold=0.8).select("doc_id", "class_id", "n_links")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = decode_ids(encode_documents(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return got.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(documents(spark, sf_dir), threshold=8, min_chars=1, edit_chars=20, percent=10)
    return got.select("doc_id", "n_lines", "n_dropped", "drops", F.sha2("text", 256).alias("kept_sha256"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = poisson_mix(documents(spark, sf_dir))
    return got.select("doc_id", "text", "lang", "source", "n_chars", "copy_no", "n_copies", F.round("rate", 6).alias("rate"), "shuffle_key")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = corpus_runs(documents(spark, sf_dir))
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run").cast("binary"))
    word = F.when(h % 31 == 0, drop_letter(F.col("run"), h % F.char_length("run"))).otherwise(F.col("run"))
    return group_variants(count_words(runs, word), ratio=10)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), every=100)


#: The sketches of quality_rules, on the same grid.
OP5_SQL = r"""
WITH t AS (SELECT *, coalesce(text, '') AS tx, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(tx, '[^\x20\x09-\x0D]+') AS ws FROM t),
f AS (SELECT doc_id, rid, lang, source, ws, len(ws) AS n_words,
      length(translate(tx, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
      length(tx) - length(translate(tx, '#*$%&|<>', '')) AS n_symbols,
      length(tx) - length(translate(tx, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS caps,
      length(tx) - length(replace(tx, '!', '')) AS bangs,
      list_filter(string_split(tx, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT rid, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS g FROM f, LATERAL (SELECT unnest(generate_series(1, len(ws) - 7)) AS i)),
dup AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, CAST(sum(least(8, i - coalesce(p, i - 8))) AS BIGINT) AS n_repeat_words FROM dup GROUP BY rid),
b AS (SELECT f.*, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      n_symbols::DOUBLE / nullif(n_words, 0) AS a1, caps::DOUBLE / nullif(word_chars, 0) AS a2, bangs::DOUBLE / nullif(n_words, 0) AS a3, word_chars::DOUBLE / nullif(n_words, 0) AS a4
      FROM f LEFT JOIN rep USING (rid)),
u AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([a1, a2, a3, a4]) AS x FROM b WHERE n_words >= 20),
v AS (SELECT lang, source, k, q, greatest(length(bin(q)) - 7, 0) AS s FROM (SELECT *, CAST(floor(x * 4096) AS BIGINT) AS q FROM u)),
c AS (SELECT lang, source, k, (q >> s) << s AS bin, count(*) AS n FROM v GROUP BY ALL),
each AS (SELECT DISTINCT lang, source, k FROM c),
l AS (SELECT lang, k, bin, CAST(round(150.0::DOUBLE * sum(n) / sum(sum(n)) OVER (PARTITION BY lang, k), 6) AS DECIMAL(28, 6)) AS w FROM c GROUP BY lang, k, bin),
a AS (SELECT k, bin, CAST(round(50.0::DOUBLE * sum(n) / sum(sum(n)) OVER (PARTITION BY k), 6) AS DECIMAL(28, 6)) AS w FROM c GROUP BY k, bin),
parts AS (SELECT lang, source, k, bin, CAST(n AS DECIMAL(28, 6)) AS w FROM c
          UNION ALL SELECT e.lang, e.source, e.k, l.bin, l.w FROM each e JOIN l ON e.lang IS NOT DISTINCT FROM l.lang AND e.k = l.k
          UNION ALL SELECT e.lang, e.source, e.k, a.bin, a.w FROM each e JOIN a ON e.k = a.k),
o AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, k ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, k) AS total FROM (SELECT lang, source, k, bin, sum(w) AS w FROM parts GROUP BY ALL)),
q AS (SELECT lang, source, k, min(CASE WHEN upto * 4 >= total THEN bin END) / 4096.0::DOUBLE AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN bin END) / 4096.0::DOUBLE AS q3 FROM o GROUP BY ALL),
fence AS (SELECT lang, source, max(CASE WHEN k = 1 THEN f END) AS f1, max(CASE WHEN k = 2 THEN f END) AS f2, max(CASE WHEN k = 3 THEN f END) AS f3, max(CASE WHEN k = 4 THEN f END) AS f4
          FROM (SELECT *, q3 + 6.0::DOUBLE * greatest(q3 - q1, CASE WHEN k = 4 THEN 1.0::DOUBLE ELSE 0.02::DOUBLE END) AS f FROM q) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN false
            ELSE coalesce(a1 <= f1 AND a2 <= f2 AND a3 <= f3 AND a4 <= f4, true) END AS kept
FROM b LEFT JOIN fence z ON b.lang IS NOT DISTINCT FROM z.lang AND b.source IS NOT DISTINCT FROM z.source
"""

OP10_SQL = """
WITH c AS (SELECT source, count(*) n, pow(count(*)::DOUBLE, 0.5) w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * w / (SELECT sum(w) FROM c) / n AS rate FROM c),
p AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT))) AS k)),
u AS (SELECT *, CAST(('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, rate, CAST((SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.u) AS INTEGER) AS n_copies
      FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS copy_no, n_copies, round(rate, 6) AS rate,
       md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i) AS shuffle_key
FROM n, LATERAL (SELECT unnest(generate_series(1, n_copies)) AS i) WHERE n_copies > 0
"""

#: Pairs of words by what they share with a letter left out; crc32 bit by bit over UTF-8 bytes (letters beyond z have two).
OP11_SQL = r"""
WITH x AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR || ':', '') || run, ''), lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)] ELSE [192 + (ord(s) >> 6), 128 + (ord(s) & 63)] END)) AS bytes FROM x),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda v: v::BIGINT)), lambda a, v: list_reduce(list_prepend(xor(a, v), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda q, z: xor(q >> 1, (q & 1) * 3988292384))), 4294967295::BIGINT) AS crc FROM b),
d AS (SELECT CASE WHEN crc % 31 = 0 THEN run[: CAST(crc % length(run) AS BIGINT)] || run[CAST(crc % length(run) AS BIGINT) + 2 :] ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
v AS (SELECT DISTINCT word, word[: i - 1] || word[i + 1 :] AS k FROM w, LATERAL (SELECT unnest(generate_series(1, length(word))) AS i) UNION ALL SELECT word, word FROM w),
p AS (SELECT DISTINCT a.word, b.word AS other FROM v a JOIN v b ON a.k = b.k AND a.word <> b.word WHERE length(a.word) <> length(b.word) OR len(list_filter(generate_series(1, length(a.word)), lambda i: a.word[i] <> b.word[i])) = 1),
m AS (SELECT p.word, count(*) AS n_near, list(other ORDER BY o.n DESC, other)[1] AS best, max(o.n) AS best_n FROM p JOIN w o ON o.word = p.other GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN m USING (word)),
r AS (SELECT *, coalesce(form, word) AS r1 FROM f), s AS (SELECT r.*, q.r1 AS r2 FROM r JOIN r q ON q.word = r.r1), t AS (SELECT s.*, q.r2 AS r4 FROM s JOIN s q ON q.word = s.r2), u AS (SELECT t.*, q.r4 AS r8 FROM t JOIN t q ON q.word = t.r4)
SELECT word, form, r8 AS root, n, n_near, form_n FROM u
"""

_RULES = {
    "assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "github": r"gh[oprsu]_[A-Za-z0-9]+",
    "slack": r"xox[abeprs]-[A-Za-z0-9-]+",
    "google": r"AIza[A-Za-z0-9_-]+",
    "stripe": r"[rs]k_(?:live|test)_[A-Za-z0-9]+",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "bearer": r"[bB][eE][aA][rR][eE][rR]\x20+[A-Za-z0-9+/_.~=-]+",
    "private": r"-----BEGIN\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY-----",
}
#: What of a match is measured, and the least length.
_LEAST = {"assign": (r"[A-Za-z0-9+/_.=-]*$", 6), "access": ("", 20), "hex": ("", 24), "github": ("", 36), "slack": ("", 20), "google": ("", 39), "stripe": ("", 24), "jwt": ("", 30), "bearer": (r"[^\x20]*$", 20), "private": ("", 1)}


def _op12_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT rid, {i} AS k, regexp_extract_all(text, '{x}') AS ms, string_split_regex(text, '{x}') AS ps FROM t" for i, x in enumerate(_RULES.values()))
    heads = f"^{_RULES['assign'].rsplit('[A-Za', 1)[0]}"
    size = "CASE " + " ".join(f"WHEN k = {i} THEN length({f"regexp_replace(m, '{heads}', '')" if kind == 'assign' else f"regexp_extract(m, '{_LEAST[kind][0]}')" if _LEAST[kind][0] else 'm'}) >= {_LEAST[kind][1]}" for i, kind in enumerate(_RULES)) + " END"
    names = "[" + ", ".join(f"'{k}'" for k in _RULES) + "]"
    told = "coalesce(string_agg(" + names + "[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), x AS ({parts}),
y AS (SELECT rid, k, ms[i] AS m, CAST(list_sum(list_transform(ps[: i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[: i - 1], lambda p: length(p))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM x WHERE len(ms) > 0)),
z AS (SELECT rid, k, s, s + length(m) AS e FROM y WHERE {size})
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256({told} FILTER (k < 3), '')) AS base_sha256, {told}, '') AS spans, count(k) AS n_spans, count(*) FILTER (k >= 3) AS n_found
FROM t LEFT JOIN z USING (rid) GROUP BY rid, doc_id"""


OP12_SQL = _op12_sql()

OP13_SQL = """
WITH r AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS au, a.vec_id AS anchor_id, b.uid AS bu, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY au ORDER BY score DESC, other, bu) AS rn FROM s WHERE same) WHERE rn <= 5),
n AS (SELECT p.au, p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.au, p.bu ORDER BY s.score DESC, s.other, s.bu) AS rank
  FROM p JOIN s ON s.au = p.au AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lpt_shards, op2_cross_parsing_langid, op3_token_counts, op4_bayesian_jaccard_join, op5_quality_rules, op6_bloom_fingerprints, op7_byte_bpe, op8_segment_line_dedup, op9_bootstrapped_pii, op10_poisson_mix, op11_spelling_variants, op12_secret_scan, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op10_poisson_mix": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_hard_negatives": OP13_SQL}
