"""Queries of the encoder and of the chunker, and of results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import signature_text
from codelode.operators import embedding
from codelode.plans.registry import CORE
from codelode.plans.search import CHUNKS, chunks
from codelode.session import table
from codelode.sources import blocks
from codelode.sources.chunker import chunk_files
from codelode.sources.python_symbols import python_symbols
from codelode.sources.store import to_json

_WORDS = f"""names AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL), w AS (SELECT name, regexp_extract_all(name, '[A-Za-z0-9_]+|[^\\s\\pL\\pN_]') AS ws FROM names),
words AS (SELECT name, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM w),
weighted AS (SELECT name, lower(word) AS low, 3.5 * greatest(0.5, 1.0 - place / 400.0) * CASE WHEN lower(word) IN ({', '.join(f"'{k}'" for k in embedding.KEYWORDS)}) THEN 2.2
  WHEN regexp_full_match(word, '[^a-z]*[A-Z][^a-z]*') AND len(word) > 1 THEN 2.0 WHEN regexp_matches(substr(word, 2), '[A-Z]') THEN 2.5 ELSE 1.0 END AS w, regexp_extract_all(lower(word), '[a-z]+|[0-9]+') AS runs FROM words),
parts AS (SELECT name, low AS token, w FROM weighted UNION ALL SELECT name, unnest(runs), w * 1.3 FROM weighted WHERE len(runs) > 1
  UNION ALL SELECT name, 'c3_' || substr(low, unnest(range(1, len(low) - 1))::INT, 3), w * 0.7 FROM weighted WHERE len(low) >= 3 UNION ALL SELECT name, 'c4_' || substr(low, unnest(range(1, len(low) - 2))::INT, 4), w * 0.5 FROM weighted WHERE len(low) >= 4),
cells AS (SELECT name, bucket, sum(v) AS total FROM (SELECT name, ('0x' || substr(md5(token), 1, 8))::UBIGINT % 384 AS bucket, w * 0.75 AS v FROM parts UNION ALL SELECT name, ('0x' || substr(md5('rot_' || token), 1, 8))::UBIGINT % 384, w * 0.25 FROM parts) GROUP BY ALL),
logs AS (SELECT name, bucket, 1.0 + ln(total) AS v FROM cells)"""


@CORE.add("subword_vectors", f"WITH {_WORDS} SELECT name, CAST(bucket AS INTEGER) AS bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY name)), 6) AS value FROM logs")
def subword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each symbol name by the built-in encoder, component by component."""
    names = table(spark, sf_dir, "symbols", "name").where("name IS NOT NULL").distinct().withColumn("text", F.col("name"))
    return embedding.bucket_weights(names, "name", "text", "symbol").withColumn("value", F.round("value", 6))


@CORE.add("document_chunks")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents, each taken as a file of its repository."""
    path = F.concat_ws("/", F.coalesce("file_path", F.lit("notes")), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    files = table(spark, sf_dir, "documents", "doc_id", "repo_id", "file_path", "text").select(F.coalesce("repo_id", F.lit("none")).alias("repo_id"), path.alias("file_path"), F.col("text").alias("content"))
    return chunk_files(files)


def _chunks_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of each chunk as a file of its own."""
    own = chunks(spark, sf_dir, "chunk_id", "repo_id", "file_path", "raw_content").where("raw_content IS NOT NULL")
    return own.select("repo_id", F.concat_ws("/", "chunk_id", "file_path").alias("file_path"), F.col("raw_content").alias("content"))


def _documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of Markdown."""
    return table(spark, sf_dir, "documents", "doc_id", "text").where("doc_id IS NOT NULL").select(F.lit("docs").alias("repo_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("content"))


@CORE.add("code_chunks")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of all chunks, in all their languages, cut anew."""
    return chunk_files(_chunks_as_files(spark, sf_dir).withColumn("content", F.regexp_replace("content", "\r\n?", "\n")))


@CORE.add("block_chunks")
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by syntax trees, braces and windows."""
    return blocks.chunk_blocks(_chunks_as_files(spark, sf_dir))


_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_DOC_LINES = f"""docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> ''), read AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(?:{_END})$', ''), '{_END}') AS ls FROM docs)"""


@CORE.add("line_windows", f"WITH {_DOC_LINES}, w AS (SELECT doc_id, ls, unnest(range(0, len(ls), 40)) AS s FROM read) SELECT doc_id || '.md' AS file_path, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 60, len(ls)) AS INTEGER) AS end_line, md5(array_to_string(ls[s + 1:s + 60], chr(10))) AS digest FROM w WHERE s = 0 OR s < len(ls) - 20")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.windows(blocks._read(_documents_as_files(spark, sf_dir).distinct()))
    return found.select("file_path", "start_line", "end_line", F.md5("raw_content").alias("digest"))


@CORE.add("heading_sections", rf"""WITH {_DOC_LINES}, l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM read), h AS (SELECT * FROM l WHERE regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^#{{1,4}}\s+.+$'))
SELECT doc_id || '.md' AS file_path, CAST(n AS INTEGER) AS start_line, CAST(coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY n) - 1, len(ls)) AS INTEGER) AS end_line, regexp_replace(regexp_replace(line, '^[# ]+|[# ]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS symbol_name FROM h""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.headings(blocks._read(_documents_as_files(spark, sf_dir).distinct()))
    return found.select("file_path", "start_line", "end_line", "symbol_name")


@CORE.add("block_ends", f"""WITH {CHUNKS}, read AS (SELECT chunk_id, regexp_split_to_array(regexp_replace(raw_content, '(?:{_END})$', ''), '{_END}') AS ls FROM chunks WHERE raw_content <> '' AND language IN ('go', 'rust', 'typescript', 'javascript')),
l AS (SELECT chunk_id, len(ls) AS total, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM read),
d AS (SELECT *, contains(line, '{{') AS opens, len(line) - len(replace(line, '{{', '')) - len(line) + len(replace(line, '}}', '')) AS delta FROM l),
c AS (SELECT *, sum(delta) OVER (PARTITION BY chunk_id ORDER BY n) AS depth FROM d),
pairs AS (SELECT a.chunk_id, a.n AS start_line, a.total, b.n, bool_or(b.opens) OVER (PARTITION BY a.chunk_id, a.n ORDER BY b.n) AND b.depth <= a.depth - a.delta OR b.n - a.n > 150 AS ends FROM c a JOIN c b ON a.chunk_id = b.chunk_id AND b.n BETWEEN a.n AND a.n + 151)
SELECT chunk_id, CAST(start_line AS INTEGER) AS start_line, CAST(coalesce(min(n) FILTER (ends), least(start_line - 1 + 40, any_value(total))) AS INTEGER) AS end_line FROM pairs GROUP BY chunk_id, start_line""")
def block_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the block ends that each line of code begins, by its braces."""
    own = chunks(spark, sf_dir, "chunk_id", "language", "raw_content").where(F.col("language").isin("go", "rust", "typescript", "javascript"))
    read = blocks._read(own.select(F.lit("").alias("repo_id"), F.col("chunk_id").alias("file_path"), F.col("raw_content").alias("content")))
    lines = read.select("repo_id", "file_path", "total", F.posexplode("lines").alias("at", "line")).withColumn("n", F.col("at") + 1)
    return blocks.block_ends(lines, lines).select(F.col("file_path").alias("chunk_id"), "start_line", F.col("end_line").cast("int").alias("end_line"))


@CORE.add("python_definitions")
def python_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the Python chunks by the syntax tree, by lines where a chunk cannot be parsed."""
    own = _chunks_as_files(spark, sf_dir).where(F.col("file_path").endswith(".py"))
    return python_symbols(own)[0]


@CORE.add("python_calls")
def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _chunks_as_files(spark, sf_dir).where(F.col("file_path").endswith(".py"))
    return python_symbols(own)[1]


@CORE.add("chunk_vectors")
def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two vectors of each chunk by the built-in encoder: of its signature text and of its content."""
    own, encoder = chunks(spark, sf_dir), embedding.SubwordEncoder()
    sig = encoder.encode(own.select("chunk_id", signature_text().alias("text")), "chunk_id", "text", "signature").withColumnRenamed("vector", "sig")
    return sig.join(encoder.encode(own, "chunk_id", "raw_content", "body").withColumnRenamed("vector", "body"), "chunk_id", "full_outer")


@CORE.add("chunk_payload", f"WITH {CHUNKS} SELECT chunk_id, json_extract_string(j, '$.symbol_name') AS symbol_name, CAST(json_extract_string(j, '$.start_line') AS INTEGER) AS start_line FROM (SELECT chunk_id, to_json({{'symbol_name': symbol_name, 'start_line': start_line}}) AS j FROM chunks)")
def chunk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as JSON and read back."""
    sent = to_json(chunks(spark, sf_dir, "chunk_id", "symbol_name", "start_line"))
    return sent.select(F.from_json("value", "chunk_id string, symbol_name string, start_line int").alias("x")).select("x.*")
