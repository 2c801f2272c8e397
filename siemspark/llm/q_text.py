"""Queries of single-pass operators over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siemspark.llm import align, bpe, katz, minhash, mixing, packing, resample, rules, squares, substring, tokencount
from siemspark.llm.common import table
from siemspark.llm.registry import query


@query("op7_bpe_round_trip")
def op7(spark, sf_dir):
    """Ids and decoded bytes of every whole text, as digests."""
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query("op9_near_duplicates")
def op9(spark, sf_dir):
    """Components of documents whose 5-word shingle sets are similar to at least 85 percent."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    """Words left after removing windows of 13 words that an earlier document holds."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_pack_sequences")
def op2(spark, sf_dir):
    """All documents as pieces of token sequences of at most 4096 ids."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_importance_resampling")
def op4(spark, sf_dir):
    """Log weight of every document and whether Gumbel top-k draws it."""
    return resample.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    """Statistics of every document and the verdict of base rule and boosted trees."""
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, table(spark, sf_dir, "labels")))


@query("op1_katz_scores")
def op1(spark, sf_dir):
    """Scores of all documents by a Katz model of the nine tenths that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return katz.score(table(spark, sf_dir, "documents"), held_out, order=3)


@query("op8_token_counts")
def op8(spark, sf_dir):
    """Tokens of every whole text under a unigram vocabulary."""
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_align_tokenizers")
def op11(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers, with corpus-wide counts of linked ids."""
    import public_tokenizers

    return align.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """Runs of at least 24 words and three periods in every document."""
    return squares.document_runs(table(spark, sf_dir, "documents"), least=24, times=3)


@query("op13_mix_sources", """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
      FROM s),
-- Sources in the order in which a rising level clamps them; n: how many lie before.
r AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS clamped, sum(weight) OVER a AS weights,
             1.5::DOUBLE * sum(source_size) OVER () AS total
      FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    a AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
-- Words as a function of the level are concave: every set of clamped sources gives a level that is too low, but the right one.
l AS (SELECT max((total - clamped) / weights) AS level FROM r),
t AS (SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
q AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS rest FROM p),
e AS (SELECT source, doc_id, size, draw, count(*) AS copies FROM d GROUP BY ALL),
g AS (SELECT *, size * copies AS words, coalesce(sum(size * copies) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT g.doc_id, g.source, g.size, q.source_size, q.target,
       CAST(q.whole * g.size + floor(greatest(0, least(q.rest - g.before, g.words)) / g.copies) AS BIGINT) AS taken
FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source, unnest(range(g.copies)) AS x""")
def op13(spark, sf_dir):
    """Words of every document that a mix of its sources takes, sources being clamped at two epochs."""
    return mixing.mix(table(spark, sf_dir, "documents"))
