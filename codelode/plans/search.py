"""Queries of the retrieval operators: tokens, postings, ranking, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import chunk_id, context_header, language, signature_text, tokens
from codelode.functions.vectors import VALID, vector
from codelode.operators import dense, fusion, lexical
from codelode.operators.graph import first_edges
from codelode.operators.relations import resolve_scope
from codelode.plans.registry import CORE
from codelode.session import table

ASKED = "merge shard queue"
SCOPED = ["atlas-core", "harbor-auth", "pebble-auth"]
TOP_K = 8
_COLUMNS = ("chunk_id", "repo_id", "file_path", "language", "start_line", "end_line", "raw_content", "symbol_name", "chunk_type", "parent_symbol", "imports_json", "docstring", "sig_embedding_json", "body_embedding_json")


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chunks, one row per id, with only the columns that are needed; for whole rows, as this shuffles them."""
    return lexical.unique_chunks(table(spark, sf_dir, "chunks_v2", *(columns or _COLUMNS)))


def _searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as they are stored, repeated rows too: the operators drop those when only numbers are left."""
    return table(spark, sf_dir, "chunks_v2", "chunk_id", "repo_id", "file_path", "start_line", "raw_content", "symbol_name", "docstring", "sig_embedding_json", "body_embedding_json")


def _asked_vectors(rows: DataFrame) -> DataFrame:
    """The vectors of the chunk with the smallest id that has both."""
    both = F.col("sig_embedding_json").rlike(VALID) & F.col("body_embedding_json").rlike(VALID)
    return dense.vectors_of(rows, rows.where(both).agg(F.min("chunk_id")).first()[0])


def _tokens(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+'), lambda w: CASE WHEN len(regexp_extract_all(w, '[a-z]+|[0-9]+')) > 1 THEN list_prepend(w, regexp_extract_all(w, '[a-z]+|[0-9]+')) ELSE [w] END))"


CHUNKS = f"chunks AS (SELECT DISTINCT {', '.join(_COLUMNS)} FROM chunks_v2)"
_FIRST = "array_to_string(string_split(coalesce(raw_content, ''), chr(10))[1:3], chr(10))"
_FIELDS = f"{CHUNKS}, fields AS (SELECT chunk_id, repo_id, {_tokens('symbol_name')} AS symbol, {_tokens(_FIRST)} AS signature, {_tokens('docstring')} AS docstring, {_tokens('raw_content')} AS body FROM chunks)"
_LENGTHS = f"{_FIELDS}, lengths AS (SELECT chunk_id, repo_id, len(symbol) AS len_symbol, len(signature) AS len_signature, len(docstring) AS len_docstring, len(body) AS len_body FROM fields)"
_POSTINGS = f"""{_LENGTHS}, postings AS (
  SELECT token, chunk_id, repo_id, count(*) FILTER (field = 'symbol') AS tf_symbol, count(*) FILTER (field = 'signature') AS tf_signature, count(*) FILTER (field = 'docstring') AS tf_docstring, count(*) FILTER (field = 'body') AS tf_body
  FROM (SELECT chunk_id, repo_id, unnest(symbol) AS token, 'symbol' AS field FROM fields UNION ALL SELECT chunk_id, repo_id, unnest(signature), 'signature' FROM fields
    UNION ALL SELECT chunk_id, repo_id, unnest(docstring), 'docstring' FROM fields UNION ALL SELECT chunk_id, repo_id, unnest(body), 'body' FROM fields) GROUP BY ALL)"""
_STATISTICS = "SELECT greatest(count(*), 1) AS n_chunks, " + ", ".join(f"greatest(1.0, coalesce(nullif(avg(len_{f}), 0), {float(d)})) AS avg_{f}" for f, (_, _, d) in lexical.FIELDS.items()) + " FROM lengths"


def _bm25f(scope: str = "") -> str:
    terms = " + ".join(f"{w} * tf_{f} / ({round(1 - b, 2)} + {b} * len_{f} / avg_{f})" for f, (w, b, _) in lexical.FIELDS.items())
    asked = ", ".join(f"'{t}'" for t in lexical.query_tokens(ASKED))
    return f"""{_POSTINGS}, own AS (SELECT * FROM lengths {scope}), hits AS (SELECT * FROM postings WHERE token IN ({asked}) AND chunk_id IN (SELECT chunk_id FROM own)),
stats AS ({_STATISTICS.replace('FROM lengths', 'FROM own')}), terms AS (
  SELECT chunk_id, token, ln(1.0 + (n_chunks - n_token + 0.5) / (n_token + 0.5)) AS idf, CAST({terms} AS DOUBLE) AS tfe
  FROM hits JOIN (SELECT token, count(*) AS n_token FROM hits GROUP BY token) USING (token) JOIN own USING (chunk_id) CROSS JOIN stats
), scored AS (SELECT chunk_id, sum(idf * tfe / (1.2 + tfe)) AS score, array_to_string(list_sort(list_distinct(list(token))), ',') AS matched_terms FROM terms GROUP BY chunk_id)"""


def _vector(column: str) -> str:
    number = r"\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*"
    return f"CASE WHEN regexp_full_match({column}, '\\[{number}(,{number})*\\]') THEN list_transform(string_split(regexp_replace({column}, '[\\[\\]\\s]', '', 'g'), ','), lambda x: CAST(x AS DOUBLE)) ELSE [] END"


def _similar(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({a}) = len({b}) THEN greatest(0.0, least(1.0, list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])))) ELSE 0.0 END"


_DENSE = f"""vectors AS (SELECT chunk_id, repo_id, {_vector('sig_embedding_json')} AS sig, {_vector('body_embedding_json')} AS body FROM chunks),
asked AS (SELECT sig AS query_sig, body AS query_body FROM vectors WHERE len(sig) > 0 AND len(body) > 0 ORDER BY chunk_id LIMIT 1),
near AS (SELECT * FROM (SELECT chunk_id, repo_id, 0.6 * {_similar('sig', 'query_sig')} + 0.4 * {_similar('body', 'query_body')} AS similarity FROM vectors CROSS JOIN asked) WHERE similarity > 0.05)"""


@CORE.add("tokenize_counts", f"WITH {_FIELDS} SELECT chunk_id, len(body) AS n_tokens, len(list_distinct(body)) AS n_distinct FROM fields")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "chunks_v2", "chunk_id", "raw_content").select("chunk_id", tokens(F.col("raw_content")).alias("t"))
    return found.select("chunk_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct")).dropDuplicates(["chunk_id"])


@CORE.add("field_lengths", f"WITH {_LENGTHS} SELECT * FROM lengths")
def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lengths(lexical.fields(_searchable(spark, sf_dir))).dropDuplicates(["chunk_id"])


@CORE.add("postings_tf", f"WITH {_POSTINGS} SELECT * FROM postings")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(lexical.fields(chunks(spark, sf_dir, "chunk_id", "repo_id", "raw_content", "symbol_name", "docstring")))


@CORE.add("corpus_stats", f"WITH {_LENGTHS} SELECT n_chunks, round(avg_symbol, 6) AS avg_symbol, round(avg_signature, 6) AS avg_signature, round(avg_docstring, 6) AS avg_docstring, round(avg_body, 6) AS avg_body FROM ({_STATISTICS})")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lexical.statistics(field_lengths(spark, sf_dir))
    return stats.select("n_chunks", *[F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in lexical.FIELDS])


@CORE.add("document_frequency", f"WITH {_POSTINGS} SELECT token, count(*) AS n_chunks, count(DISTINCT repo_id) AS n_repos FROM postings GROUP BY token")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(lexical.fields(chunks(spark, sf_dir, "chunk_id", "repo_id", "raw_content", "symbol_name", "docstring"))).groupBy("token").agg(F.count("*").alias("n_chunks"), F.count_distinct("repo_id").alias("n_repos"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", F.round("score", 6).alias("score"), F.array_join("matched_terms", ",").alias("matched_terms"))


_TOP_WORDS = " SELECT chunk_id, round(score, 6) AS score, matched_terms FROM scored"


@CORE.add("bm25f_scores", f"WITH {_bm25f()}{_TOP_WORDS}")
def bm25f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.bm25f(_searchable(spark, sf_dir), ASKED))


@CORE.add("bm25f_topk", f"WITH {_bm25f()}{_TOP_WORDS} ORDER BY round(scored.score, 12) DESC, chunk_id LIMIT {3 * TOP_K}")
def bm25f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.top(lexical.bm25f(_searchable(spark, sf_dir), ASKED), 3 * TOP_K))


_IN_SCOPE = "WHERE repo_id IN (" + ", ".join(f"'{r}'" for r in SCOPED) + ")"


@CORE.add("bm25f_scoped", f"WITH {_bm25f(_IN_SCOPE)}{_TOP_WORDS}")
def bm25f_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.bm25f(_searchable(spark, sf_dir), ASKED, SCOPED))


@CORE.add("dense_scores", f"WITH {CHUNKS}, {_DENSE} SELECT chunk_id, round(similarity, 6) AS similarity FROM near")
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searchable(spark, sf_dir)
    return dense.dense(rows, _asked_vectors(rows)).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@CORE.add("dense_topk", f"WITH {CHUNKS}, {_DENSE} SELECT chunk_id, round(similarity, 6) AS similarity FROM near ORDER BY round(near.similarity, 12) DESC, chunk_id LIMIT {3 * TOP_K}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searchable(spark, sf_dir)
    return lexical.top(dense.dense(rows, _asked_vectors(rows)), 3 * TOP_K, "similarity").select("chunk_id", F.round("similarity", 6).alias("similarity"))


def _fused(scope: str = "") -> str:
    near = "near" if not scope else f"(SELECT * FROM near {scope})"
    return f"""{_bm25f(scope)}, {_DENSE},
by_vector AS (SELECT chunk_id, row_number() OVER (ORDER BY round(similarity, 12) DESC, chunk_id) AS dense_rank FROM {near} QUALIFY dense_rank <= {3 * TOP_K}),
by_words AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 12) DESC, chunk_id) AS sparse_rank FROM scored QUALIFY sparse_rank <= {3 * TOP_K}),
fused AS (SELECT chunk_id, dense_rank, sparse_rank, coalesce(1.0 / (60 + dense_rank), 0) + coalesce(0.85 / (60 + sparse_rank), 0) AS score FROM by_vector FULL JOIN by_words USING (chunk_id))"""


@CORE.add("rrf_fusion", f"WITH {_fused()} SELECT chunk_id, dense_rank, sparse_rank, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searchable(spark, sf_dir)
    return fusion.candidates(dense.dense(rows, _asked_vectors(rows)), lexical.bm25f(rows, ASKED), TOP_K).withColumn("score", F.round("score", 6))


EDGES = "edges AS (SELECT * FROM call_edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY indexed_at, source_repo, source_file, source_symbol, target_repo, target_file, target_symbol, edge_type, line_number) = 1)"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def like(text: str, part: str) -> str:
    return f"{FOLD.format(text)} LIKE '%' || replace({FOLD.format(part)}, '\\', '\\\\') || '%' ESCAPE '\\'"


def centrality_sql(owners: str) -> str:
    return f"""{EDGES}, calls AS (SELECT target_symbol, source_repo, count(*) AS n FROM edges WHERE target_symbol IS NOT NULL GROUP BY ALL),
owners AS ({owners}), usage AS (SELECT name, sum(n) AS n, count(DISTINCT source_repo) AS repos, min(source_repo) AS one FROM (SELECT DISTINCT name FROM owners WHERE name <> '') JOIN calls ON {like('target_symbol', 'name')} GROUP BY name),
boosts AS (SELECT name, owner, least(0.08, coalesce(ln(1.0 + n) * 0.02 * CASE WHEN repos > 1 OR (owner IS NOT NULL AND one <> owner) THEN 1.8 ELSE 1.0 END, 0.0)) AS centrality FROM (SELECT DISTINCT name, owner FROM owners) LEFT JOIN usage USING (name))"""


def _hybrid(scope: str = "", factor: str = "1.0", relation: str = "'primary'", direction: str = "CAST(NULL AS VARCHAR)", hops: str = "0", join: str = "") -> str:
    low = ASKED.lower()
    return f"""{_fused(scope)}, rows AS (SELECT c.chunk_id, c.repo_id, c.file_path, c.symbol_name, f.dense_rank, f.sparse_rank, f.score FROM chunks c JOIN fused f USING (chunk_id)),
{centrality_sql("SELECT symbol_name AS name, repo_id AS owner FROM rows WHERE symbol_name <> ''")},
final AS (SELECT r.*, {relation} AS relation, {direction} AS direction, {hops} AS hops,
  (r.score + CASE WHEN symbol_name <> '' AND (contains(lower(symbol_name), '{low}') OR contains('{low}', lower(symbol_name))) THEN 0.020 ELSE 0.0 END + coalesce(centrality, 0.0)) * {factor} AS total
  FROM rows r LEFT JOIN boosts b ON b.name = r.symbol_name AND b.owner = r.repo_id {join})
SELECT chunk_id, repo_id, file_path, symbol_name, dense_rank, sparse_rank, round(total, 6) AS score, relation, direction, hops FROM final
ORDER BY round(total, 12) DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, chunk_id LIMIT {TOP_K}"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_edges(table(spark, sf_dir, "call_edges", "edge_id", "source_repo", "source_file", "source_symbol", "target_repo", "target_file", "target_symbol", "edge_type", "line_number", "indexed_at"))


@CORE.add("hybrid_search", f"WITH {_hybrid()}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searchable(spark, sf_dir)
    return fusion.hybrid(rows, _edges(spark, sf_dir), ASKED, _asked_vectors(rows), TOP_K)


_DOWN = """scope AS (SELECT repo_id, 'primary' AS relation, CAST(NULL AS VARCHAR) AS direction, 0 AS hops FROM repositories WHERE repo_id = 'atlas-core'
  UNION ALL SELECT DISTINCT r.repo_id, 'expanded', 'downstream', 1 FROM repo_dependencies d JOIN repositories r ON r.repo_id = d.repo_id WHERE d.depends_on_repo_id = 'atlas-core' AND d.repo_id <> 'atlas-core')"""


@CORE.add(
    "hybrid_hop_decay",
    f"WITH {_DOWN}, " + _hybrid("WHERE repo_id IN (SELECT repo_id FROM scope)", "CASE WHEN s.relation = 'expanded' THEN pow(0.85, greatest(1, s.hops)) ELSE 1.0 END", "s.relation", "s.direction", "s.hops", "JOIN scope s ON s.repo_id = r.repo_id"),
)
def hybrid_hop_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searchable(spark, sf_dir)
    repositories = table(spark, sf_dir, "repositories", "repo_id", "name")
    dependencies = table(spark, sf_dir, "repo_dependencies", "repo_id", "depends_on_repo_id")
    members = repositories.select(F.lit("all").alias("group_name"), "repo_id")
    scope = resolve_scope(repositories, dependencies, members, ["atlas-core"], expand="downstream", depth=1)
    return fusion.hybrid(rows, _edges(spark, sf_dir), ASKED, _asked_vectors(rows), TOP_K, scope)


@CORE.add(
    "hybrid_enriched",
    None,
)
def hybrid_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    found = fusion.enrich(hybrid_search(spark, sf_dir), edges)
    return found.withColumn("related_callers", F.to_json("related_callers")).withColumn("related_callees", F.to_json("related_callees"))


def _enriched_sql(side: str) -> str:
    found = _hybrid().replace("ORDER BY round(total, 12)", "ORDER BY round(final.total, 12)")
    join = "e.target_symbol = f.symbol_name" if side == "callers" else "e.source_repo = f.repo_id AND e.source_symbol = f.symbol_name"
    head, _, tail = found.rpartition("SELECT chunk_id, repo_id, file_path, symbol_name, dense_rank")
    return f"WITH {head}, found AS (SELECT chunk_id, repo_id, file_path, symbol_name, dense_rank{tail}) SELECT f.chunk_id, CAST(row_number() OVER (PARTITION BY f.chunk_id ORDER BY e.edge_id) AS INTEGER) AS rank, e.source_repo, e.source_file, e.source_symbol, e.target_symbol, e.edge_type, e.line_number FROM found f JOIN edges e ON {join} QUALIFY rank <= 3"


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.enrich(hybrid_search(spark, sf_dir), _edges(spark, sf_dir))


@CORE.add("enriched_callers", _enriched_sql("callers"))
def enriched_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three callers of the symbol of each result of a search."""
    rows = _enriched(spark, sf_dir).select("chunk_id", "symbol_name", F.explode("related_callers").alias("x"))
    return rows.select("chunk_id", "x.rank", "x.source_repo", "x.source_file", "x.source_symbol", F.col("symbol_name").alias("target_symbol"), "x.edge_type", "x.line_number")


@CORE.add("enriched_callees", _enriched_sql("callees").replace("e.source_file, ", ""))
def enriched_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _enriched(spark, sf_dir).select("chunk_id", "repo_id", "symbol_name", F.explode("related_callees").alias("x"))
    return rows.select("chunk_id", "x.rank", F.col("repo_id").alias("source_repo"), F.col("symbol_name").alias("source_symbol"), "x.target_symbol", "x.edge_type", "x.line_number")


_IMPORTS = "coalesce(try_cast(try_cast(imports_json AS JSON) AS VARCHAR[]), [])"


@CORE.add(
    "signature_text",
    f"""WITH {CHUNKS} SELECT chunk_id, concat_ws(chr(10), 'symbol: ' || nullif(symbol_name, ''), 'scope: ' || nullif(parent_symbol, ''), 'kind: ' || chunk_type, 'doc: ' || nullif(docstring, ''),
  CASE WHEN len({_IMPORTS}) > 0 THEN 'imports: ' || array_to_string({_IMPORTS}[1:3], ', ') END, {_FIRST}) AS signature_text FROM chunks""",
)
def signature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", signature_text().alias("signature_text"))


@CORE.add(
    "context_header",
    f"""WITH {CHUNKS} SELECT chunk_id, concat_ws(chr(10), '// [Context] Repository: ' || repo_id || ' | File: ' || file_path || ' | Language: ' || language,
  CASE WHEN symbol_name <> '' AND parent_symbol <> '' THEN '// Scope: ' || parent_symbol || ' -> ' || symbol_name || ' (' || chunk_type || ')'
       WHEN symbol_name <> '' THEN '// Symbol: ' || symbol_name || ' (' || chunk_type || ')' WHEN chunk_type <> 'block' THEN '// Type: ' || chunk_type END,
  CASE WHEN len({_IMPORTS}) > 0 THEN '// Top Imports: ' || array_to_string({_IMPORTS}[1:4], ', ') END, '// Doc: ' || left(replace(nullif(docstring, ''), chr(10), ' '), 150)) AS header FROM chunks""",
)
def context_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", context_header().alias("header"))


@CORE.add("chunk_ids", f"WITH {CHUNKS} SELECT chunk_id, substr(sha256(repo_id || ':' || file_path || ':' || start_line || ':' || end_line), 1, 16) AS derived_id FROM chunks")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "chunk_id", "repo_id", "file_path", "start_line", "end_line").select("chunk_id", chunk_id().alias("derived_id"))


_LANGUAGE = """CASE lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript'
  WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java'
  WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.cxx' THEN 'cpp' WHEN '.hpp' THEN 'cpp' WHEN '.hxx' THEN 'cpp' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.cs' THEN 'csharp' WHEN '.rb' THEN 'ruby'
  WHEN '.php' THEN 'php' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.sql' THEN 'sql' WHEN '.sol' THEN 'solidity'
  WHEN '.json' THEN 'json' WHEN '.yaml' THEN 'yaml' WHEN '.yml' THEN 'yaml' WHEN '.toml' THEN 'toml' WHEN '.sh' THEN 'bash' WHEN '.bash' THEN 'bash' WHEN '.zsh' THEN 'bash' ELSE 'text' END"""


@CORE.add("files_by_language", f"SELECT {_LANGUAGE} AS language, count(*) AS n FROM (SELECT DISTINCT repo_id, file_path FROM file_hashes) GROUP BY ALL")
def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_hashes", "repo_id", "file_path").distinct()
    return files.groupBy(language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


@CORE.add(
    "vector_health",
    f"WITH {CHUNKS}, v AS (SELECT repo_id, {_vector('sig_embedding_json')} AS sig, {_vector('body_embedding_json')} AS body FROM chunks) SELECT repo_id, len(sig) AS sig_size, len(body) AS body_size, count(*) AS n FROM v GROUP BY ALL",
)
def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [F.coalesce(F.size(vector(F.col(f"{c}_embedding_json"))), F.lit(0)).alias(f"{c}_size") for c in ("sig", "body")]
    rows = table(spark, sf_dir, "chunks_v2", "chunk_id", "repo_id", "sig_embedding_json", "body_embedding_json").select("chunk_id", "repo_id", *sizes).dropDuplicates(["chunk_id"])
    return rows.groupBy("repo_id", "sig_size", "body_size").agg(F.count("*").alias("n"))
