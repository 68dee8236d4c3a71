"""The queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.llm import docpairs, handwritten, language, mixing, similar, splitting, tokens
from codelode.plans.registry import Registry
from codelode.session import cut, table

LLM = Registry()
QUERIES = LLM.queries
ORACLE_SQL = LLM.sql


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.vectors(table(spark, sf_dir, "chunks_v2", "chunk_id", "sig_embedding_json", "body_embedding_json"))


_NUMBER = r"\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*"


@LLM.add(
    "p1_found",
    rf"""
WITH raw AS (SELECT DISTINCT chunk_id, 'sig' AS vec, sig_embedding_json AS j FROM chunks_v2 UNION SELECT chunk_id, 'body', body_embedding_json FROM chunks_v2),
numbers AS (SELECT vec, chunk_id, list_transform(string_split(regexp_replace(j, '[\[\]\s]', '', 'g'), ','), lambda x: CAST(x AS DOUBLE)) AS v FROM raw WHERE regexp_full_match(j, '\s*\[{_NUMBER}(,{_NUMBER})*\]\s*')),
whole AS (SELECT vec, chunk_id, CAST(v AS DOUBLE[64]) AS v FROM numbers WHERE len(v) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec, a.chunk_id AS a, b.chunk_id AS b, array_cosine_similarity(a.v, b.v) AS s FROM whole a JOIN whole b ON a.vec = b.vec AND a.chunk_id <> b.chunk_id),
best AS (SELECT * FROM pairs WHERE s >= 0.945 QUALIFY row_number() OVER (PARTITION BY vec, a ORDER BY round(s, 9) DESC, b) <= 5)
SELECT DISTINCT vec, least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM best
""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar.close_pairs(_vectors(spark, sf_dir), 0.945)
    return found.select("vec", F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@LLM.add("p1_neighbours")
def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.neighbours(_vectors(spark, sf_dir))


@LLM.add(
    "p1_members",
    rf"""
WITH raw AS (SELECT DISTINCT chunk_id, 'sig' AS vec, sig_embedding_json AS j FROM chunks_v2 UNION SELECT chunk_id, 'body', body_embedding_json FROM chunks_v2),
numbers AS (SELECT vec, chunk_id, list_transform(string_split(regexp_replace(j, '[\[\]\s]', '', 'g'), ','), lambda x: CAST(x AS DOUBLE)) AS v FROM raw WHERE regexp_full_match(j, '\s*\[{_NUMBER}(,{_NUMBER})*\]\s*')),
whole AS (SELECT vec, chunk_id, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM numbers WHERE len(v) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
unit AS (SELECT vec, chunk_id, list_transform(v, lambda x: CAST(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS FLOAT)) AS v FROM whole)
SELECT vec, chunk_id, min(chunk_id) OVER (PARTITION BY vec, v) AS class_id, count(*) OVER (PARTITION BY vec, v) AS copies FROM unit
""",
)
def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal vectors to which each chunk belongs; p1_neighbours names classes by their smallest ids."""
    return similar.members(_vectors(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


@LLM.add("p1_found_recall")
def p1_found_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return similar.pair_recall(rows, similar.close_pairs(rows, 0.945), 0.945)


@LLM.add("p1_recall")
def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return similar.recall(rows, similar.neighbours(rows))


def _doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "symbols", "symbol_id", "repo_id", "file_path", "name", "kind", "line_number", "docstring", "parent_symbol", "indexed_at")
    chunks = table(spark, sf_dir, "chunks_v2", "chunk_id", "repo_id", "file_path", "symbol_name", "language", "start_line", "raw_content")
    return docpairs.pairs(symbols, chunks)


@LLM.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pairs(spark, sf_dir).select("symbol_id")


@LLM.add("p3_pairs")
def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pairs(spark, sf_dir)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "chunks_v2", "chunk_id", "raw_content", "start_line"))


@LLM.add(
    "p4_found",
    """
SELECT DISTINCT chunk_id, CASE WHEN list_max(list_transform(string_split(raw_content, chr(10)), lambda x: length(x) - CASE WHEN ends_with(x, chr(13)) THEN 1 ELSE 0 END)) <= 800 THEN 'line' ELSE 'inside' END AS cut
FROM chunks_v2 WHERE length(raw_content) > 800
""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).where("piece_no = 0").select("chunk_id", "cut").distinct()


@LLM.add("p4_pieces")
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


@LLM.add(
    "p4_cover",
    """
SELECT DISTINCT chunk_id, length(raw_content) AS chars, TRUE AS begins, 0 AS gaps, 0 AS too_long, 0 AS too_wide, 0 AS standing,
  CASE WHEN list_max(list_transform(string_split(raw_content, chr(10)), lambda x: length(x) - CASE WHEN ends_with(x, chr(13)) THEN 1 ELSE 0 END)) <= 800 THEN 0 ELSE -1 END AS broken_lines
FROM chunks_v2 WHERE length(raw_content) > 800
""",
)
def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of each chunk: they cover it, keep limit and overlap, go on, and leave lines whole if those fit."""
    pieces = _split(spark, sf_dir)
    before = F.lag("end_char").over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    after = F.lead("start_char").over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    # what follows the cut is in the next piece, behind what both share
    follows = F.lead("piece").over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    rest = F.expr("substring(follows, end_char - after + 1, 2)")
    whole = F.col("piece").endswith("\n") | rest.startswith("\n") | (rest == "\r\n") | F.col("after").isNull()
    rows = pieces.withColumns({"before": before, "after": after, "follows": follows})
    counts = {
        "gaps": F.col("start_char") > F.col("before"), "too_long": (F.length("piece") > splitting.LIMIT) | (F.length("piece") != F.col("end_char") - F.col("start_char")),
        "too_wide": F.col("before") - F.col("start_char") > splitting.OVERLAP, "standing": F.col("end_char") <= F.col("before"),
    }
    found = rows.groupBy("chunk_id").agg(F.max("end_char").alias("chars"), (F.min("start_char") == 0).alias("begins"), *[F.count_if(c).cast("int").alias(n) for n, c in counts.items()], F.count_if(~whole).cast("int").alias("broken"), F.max("cut").alias("kind"))
    return found.select("chunk_id", "chars", "begins", *counts, F.when(F.col("kind") == "line", F.col("broken")).otherwise(-1).alias("broken_lines"))


@LLM.add("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


@LLM.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(table(spark, sf_dir, "documents", "doc_id", "lang", "text"), table(spark, sf_dir, "lang_samples", "lang", "text"))


@LLM.add("p8_segments")
def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(table(spark, sf_dir, "documents", "doc_id", "lang", "text"), table(spark, sf_dir, "lang_samples", "lang", "text"))


@LLM.add("p8_coverage")
def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return language.coverage(documents, language.segments(documents, table(spark, sf_dir, "lang_samples", "lang", "text")))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # the sizes are read by the totals and by the sampling; encoding the corpus twice would cost more than writing them
    sizes = cut(mixing.token_sizes(table(spark, sf_dir, "documents", "doc_id", "source", "text")))
    plan = mixing.plans(sizes, table(spark, sf_dir, "mixture_targets", "mix_id", "source", "target_share", "max_repeats", "budget_ratio"))
    return mixing.mix(sizes, plan), plan


@LLM.add("p7_mixture")
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


@LLM.add("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(*_mixture(spark, sf_dir))


def _not_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_hashes", "repo_id", "file_path", "size_bytes", "last_modified")
    chunks = table(spark, sf_dir, "chunks_v2", "chunk_id", "repo_id", "file_path", "raw_content", "language", "chunk_type", "start_line")
    return handwritten.judge(files, chunks, table(spark, sf_dir, "repo_dependencies", "repo_id", "depends_on_repo_id"))


@LLM.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _not_handwritten(spark, sf_dir).select("repo_id", "file_path")


@LLM.add("p2_reasons")
def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _not_handwritten(spark, sf_dir)
