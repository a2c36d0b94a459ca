"""Named queries over the tables of a data folder, one or more per operator, and DuckDB SQL for them.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLES`` maps it to
SQL that gives the same rows where SQL can.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import languages, paths
from tessera.functions.text import embedding_input, line_count, tokens
from tessera.functions.vectors import as_double, cosine
from tessera.operators import blockmax, bm25, chunking, folder_tree, fusion, neighbour_graph, sync, vector
from tessera.plans.corpus import FILES_SQL, ROOT, files, pages, query_vector, table, texts, vectors
from tessera.sources.embedding import HashingEmbedder, embedding
from tessera.sources.places import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIZE, OVERLAP = 1000, 200
TERMS = ["the", "and", "tion"]
QUERY = " ".join(TERMS)
CANDIDATES, RRF_K = 50, 100


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- projections and filters -------------------------------------------------

_EXTS = ", ".join(f"'{e}'" for e in languages.DEFAULT_EXTENSIONS)


@query(f"WITH {FILES_SQL} SELECT id, path, ext FROM files WHERE ext IN ({_EXTS}) AND ext <> '.txt'")
def ext_filter(spark, sf_dir):
    """Files with one of the scanned extensions, plain text left out."""
    wanted = [e for e in languages.DEFAULT_EXTENSIONS if e != ".txt"]
    return files(spark, sf_dir).filter(F.col("ext").isin(wanted)).select("id", "path", "ext")


@query(f"WITH {FILES_SQL} SELECT id, CASE ext WHEN '.md' THEN 'markdown' WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' ELSE 'unknown' END AS language FROM files")
def lang_detect(spark, sf_dir):
    return files(spark, sf_dir).select("id", "language")


_NAMES = ["Rust", "py", "JS", "ts", "c++", "C#", "ex", "Objective-C", "md", "YML", "sass", "toml", "cobol", "go"]


@query(
    "SELECT id, name, CASE lower(name) WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'c++' THEN 'cpp' WHEN 'c#' THEN 'csharp' WHEN 'ex' THEN 'elixir' "
    "WHEN 'objective-c' THEN 'objc' WHEN 'md' THEN 'markdown' WHEN 'yml' THEN 'yaml' WHEN 'sass' THEN 'scss' WHEN 'rust' THEN 'rust' WHEN 'toml' THEN 'toml' WHEN 'go' THEN 'go' "
    f"ELSE 'unknown' END AS language FROM (SELECT doc_id AS id, ([{', '.join(map(repr, _NAMES))}])[(doc_id % {len(_NAMES)} + 1)::INT] AS name FROM documents)"
)
def lang_alias(spark, sf_dir):
    """A language name that each document claims, by its id, and what is meant by it."""
    claimed = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("id") % len(_NAMES) + 1).cast("int"))
    return texts(spark, sf_dir).select("id", claimed.alias("name")).withColumn("language", languages.canonical_language(F.col("name")))


@query(
    "SELECT id, ext, starts_with(ext, '.') AND length(ext) > 1 AND NOT contains(ext, ' ') AS valid FROM (SELECT doc_id AS id, "
    "CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.' END || substring(coalesce(text, ''), 1, (doc_id % 5)::INT) AS ext FROM documents)"
)
def ext_validate(spark, sf_dir):
    """The beginnings of documents as extension filters: without a dot, empty, with spaces, and sound ones."""
    dot = F.when(F.col("id") % 3 == 0, "").otherwise(".")
    ext = F.concat(dot, F.substr(F.coalesce("content", F.lit("")), F.lit(1), (F.col("id") % 5).cast("int")))
    return texts(spark, sf_dir).select("id", ext.alias("ext")).withColumn("valid", languages.valid_extension(F.col("ext")))


@query(f"WITH {FILES_SQL} SELECT id, CASE WHEN source = 'src0' AND starts_with(path, '/corpus/src0/') THEN substring(path, 14) ELSE path END AS below FROM files")
def rel_path(spark, sf_dir):
    """Paths below one source's folder; others stay as they are."""
    return files(spark, sf_dir).select("id", paths.relative_path(F.col("path"), f"{ROOT}/src0").alias("below"))


@query(f"WITH {FILES_SQL} SELECT DISTINCT source, substring(sha256('/corpus/' || source), 1, 16) AS store, md5('/corpus/' || source) AS snapshot FROM files")
def store_key(spark, sf_dir):
    root = F.concat(F.lit(f"{ROOT}/"), "source")
    return files(spark, sf_dir).select("source").distinct().select("source", paths.store_key(root).alias("store"), F.md5(root.cast("binary")).alias("snapshot"))


@query("SELECT doc_id AS id, strlen(text)::BIGINT AS n_bytes FROM documents WHERE strlen(text) <= 5000")
def size_cap(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.octet_length("content").cast("long").alias("n_bytes")).filter("n_bytes <= 5000")


_CUT = f"(CASE WHEN length(content) <= {SIZE} THEN 1 ELSE ceil((length(content) - {SIZE})::DOUBLE / {SIZE - OVERLAP})::BIGINT + 1 END)"


@query(
    f"WITH {FILES_SQL}, counts AS (SELECT path, {_CUT} AS n FROM files WHERE length(content) > 0), placed AS (SELECT path, n, coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts) SELECT path, n::BIGINT AS n, before::BIGINT AS before FROM placed WHERE before < 150"
)
def chunk_cap(spark, sf_dir):
    n = F.when(F.length("content") <= SIZE, 1).otherwise(F.ceil((F.length("content") - SIZE) / (SIZE - OVERLAP)) + 1)
    counts = files(spark, sf_dir).filter(F.length("content") > 0).select("path", n.cast("long").alias("n"))
    return chunking.within_cap(counts, 150)


_PATTERNS = ["src1*", "*.py", "src3/2*", "src7/", "*9.md"]


@query(
    f"WITH {FILES_SQL} SELECT id, relative_path FROM files WHERE NOT (regexp_matches(relative_path, '(^|/)src1[^/]*(/|$)') OR regexp_matches(relative_path, '(^|/)[^/]*\\.py(/|$)') "
    "OR regexp_matches(relative_path, '^src3/2.*(/.*)?$') OR regexp_matches(relative_path, '(^|/)src7(/|$)') OR regexp_matches(relative_path, '(^|/)[^/]*9\\.md(/|$)'))"
)
def ignore_glob(spark, sf_dir):
    return files(spark, sf_dir).filter(~paths.is_ignored(F.col("relative_path"), _PATTERNS)).select("id", "relative_path")


@query(
    f"WITH {FILES_SQL}, dotted AS (SELECT id, CASE WHEN id % 5 = 0 THEN '.' || relative_path WHEN id % 7 = 0 THEN replace(relative_path, '/', '/.') ELSE relative_path END AS relative_path FROM files) "
    "SELECT id, relative_path FROM dotted WHERE NOT regexp_matches(relative_path, '(^|/)\\.')"
)
def hidden_ignore(spark, sf_dir):
    p = F.col("relative_path")
    dotted = F.when(F.col("id") % 5 == 0, F.concat(F.lit("."), p)).when(F.col("id") % 7 == 0, F.replace(p, F.lit("/"), F.lit("/."))).otherwise(p)
    return files(spark, sf_dir).select("id", dotted.alias("relative_path")).filter(~paths.is_hidden(p))


_LINES = "(length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN {0} = '' OR right({0}, 1) = chr(10) THEN 0 ELSE 1 END)::BIGINT"


@query(f"SELECT doc_id AS id, {_LINES.format('text')} AS n_lines, strlen(text)::BIGINT AS n_bytes FROM documents")
def line_counts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", line_count(F.col("content")).alias("n_lines"), F.octet_length("content").cast("long").alias("n_bytes"))


# -- chunks ------------------------------------------------------------------

_CHUNKS_SQL = f"""{FILES_SQL}, cut AS (
  SELECT id, path, content, unnest(range({_CUT}::BIGINT)) AS k FROM files WHERE length(content) > 0
), pieces AS (
  SELECT id, path, k, substring(content, k * {SIZE - OVERLAP} + 1, {SIZE}) AS piece, substring(content, 1, k * {SIZE - OVERLAP}) AS lead FROM cut
), lined AS (
  SELECT *, (length(lead) - length(replace(lead, chr(10), '')) + 1)::BIGINT AS start_line, {_LINES.format('piece')} AS n_lines FROM pieces
), chunks AS (
  SELECT id, path, k, piece, start_line, start_line + greatest(n_lines, 1) - 1 AS end_line FROM lined
)"""


def _char_chunks(spark, sf_dir) -> DataFrame:
    return chunking.with_lines(chunking.char_chunks(files(spark, sf_dir).select("id", "path", "content"), SIZE, OVERLAP))


@query(f"WITH {_CHUNKS_SQL} SELECT id, k, md5(piece) AS digest, length(piece)::BIGINT AS n FROM chunks")
def chunk_chars(spark, sf_dir):
    return _char_chunks(spark, sf_dir).select("id", F.col("k").cast("long").alias("k"), F.md5(F.col("piece").cast("binary")).alias("digest"), F.length("piece").cast("long").alias("n"))


@query(f"WITH {_CHUNKS_SQL} SELECT id, k, start_line, end_line, sha256(path || ':' || start_line::VARCHAR || ':' || end_line::VARCHAR) AS chunk_id FROM chunks")
def chunk_ids(spark, sf_dir):
    return _char_chunks(spark, sf_dir).select(
        "id", F.col("k").cast("long").alias("k"), "start_line", "end_line", chunking.id_of(F.col("path"), F.col("start_line"), F.col("end_line")).alias("chunk_id")
    )


@query(
    f"WITH {_CHUNKS_SQL}, named AS (SELECT *, sha256(path || ':' || start_line::VARCHAR || ':' || end_line::VARCHAR) AS chunk_id FROM chunks), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY k) AS n FROM named) SELECT chunk_id, k FROM numbered WHERE n = 1"
)
def chunk_dedup(spark, sf_dir):
    named = _char_chunks(spark, sf_dir).select(chunking.id_of(F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"), F.col("k").cast("long").alias("ord"))
    return chunking.first_of_each_id(named).select(F.col("id").alias("chunk_id"), F.col("ord").alias("k"))


@query(
    "WITH led AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, "
    "CASE WHEN before IS NULL THEN text ELSE substring(before, greatest(length(before) - 19, 1), 20) || chr(10) || text END AS content FROM led"
)
def chunk_overlap(spark, sf_dir):
    """Each turn led by the end of the turn before."""
    turns = table(spark, sf_dir, "conversations").withColumn("tail", chunking.previous_tail("text", "conv_id", "turn", 20))
    led = F.when(F.col("tail").isNull(), F.col("text")).otherwise(F.concat("tail", F.lit("\n"), "text"))
    return turns.select("conv_id", "turn", led.alias("content"))


def _flat(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "relative_path", "start_line", "end_line", "language", "ord", "metadata.*")


def _whole(at: str) -> str:
    """SQL: whether no character is cut at a byte of h, a text's bytes in hexadecimal, n of them."""
    return f"({at} >= n OR substring(h, 2 * ({at}) + 1, 1) NOT IN ('8', '9', 'A', 'B'))"


def _moved(at: str, by: int) -> str:
    """SQL: the nearest byte before or after ``at`` that cuts no character."""
    return "CASE " + " ".join(f"WHEN {_whole(f'{at} + {k * by}')} THEN {at} + {k * by}" for k in range(3)) + f" ELSE {at} + {3 * by} END"


BYTES_SQL = f"""RECURSIVE {FILES_SQL}, raw AS (
  SELECT id, path, relative_path, ext, hex(encode(content)) AS h, strlen(content)::BIGINT AS n FROM files
), cut AS (
  SELECT id, 0::BIGINT AS k, 0::BIGINT AS a, {_moved(f"least({SIZE}, n)", -1)} AS b FROM raw WHERE n > 0
  UNION ALL
  SELECT id, k, a, {_moved(f"least(a + {SIZE}, n)", -1)} AS b FROM (SELECT cut.id, k + 1 AS k, {_moved(f"b - {OVERLAP}", 1)} AS a, h, n FROM cut JOIN raw ON cut.id = raw.id WHERE b < n)
), pieces AS (
  SELECT path, relative_path, ext, k, decode(unhex(substring(h, 2 * a + 1, 2 * (b - a)))) AS piece, decode(unhex(substring(h, 1, 2 * a))) AS lead FROM cut JOIN raw ON cut.id = raw.id
), lined AS (
  SELECT *, (length(lead) - length(replace(lead, chr(10), '')) + 1)::BIGINT AS start_line, {_LINES.format('piece')} AS n_lines FROM pieces
), ended AS (SELECT *, start_line + greatest(n_lines, 1) - 1 AS end_line FROM lined)"""


@query(
    f"WITH {BYTES_SQL} SELECT sha256(path || ':' || start_line::VARCHAR || ':' || end_line::VARCHAR || ':' || k::VARCHAR) AS id, relative_path, start_line, end_line, "
    "CASE ext WHEN '.md' THEN 'markdown' WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' ELSE 'unknown' END AS language, k AS ord, ltrim(ext, '.') AS file_extension, k AS chunk_index, sha256(piece) AS hash FROM ended"
)
def chunk_bytes(spark, sf_dir):
    """Byte-exact fixed-size pieces of all documents."""
    return _flat(chunking.chunk_files(files(spark, sf_dir), SIZE, OVERLAP, "langchain", max_bytes=None))


@query()
def chunk_refine(spark, sf_dir):
    """Structural chunks of all documents: most have no nodes, so long ones are refined by lines."""
    return _flat(chunking.chunk_files(files(spark, sf_dir), SIZE, OVERLAP, "ast", max_bytes=None))


@query("SELECT page_id AS id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>')) AS span FROM pages")
def html_script_style(spark, sf_dir):
    found = F.regexp_extract_all("content", F.lit(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"), F.lit(0))
    return pages(spark, sf_dir).select("id", F.explode(found).alias("span"))


@query()
def html_elements(spark, sf_dir):
    return _flat(chunking.chunk_files(pages(spark, sf_dir), SIZE, OVERLAP, max_bytes=None))


@query(
    "WITH own AS (SELECT '/corpus/events/' || event_id::VARCHAR || '.json' AS path, props FROM events) SELECT sha256(path || ':1:1') AS id, path AS relative_path, 1::BIGINT AS start_line, "
    "1::BIGINT AS end_line, 'json' AS language, 0::BIGINT AS ord, 'json' AS file_extension, 0::BIGINT AS chunk_index, sha256(props) AS hash FROM own"
)
def json_nodes(spark, sf_dir):
    """Objects in the events' properties, each of which is one flat object on one line."""
    named = table(spark, sf_dir, "events").select(F.concat(F.lit("/corpus/events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("content"))
    return _flat(chunking.chunk_files(named.select("path", F.col("path").alias("relative_path"), F.lit(".json").alias("ext"), F.lit("json").alias("language"), "content"), max_bytes=None))


def _rewritten(spark, sf_dir, ext: str, language: str, content) -> DataFrame:
    """All documents as files of another language."""
    path = F.concat(F.lit(f"{ROOT}/{language}/"), F.col("id").cast("string"), F.lit(ext))
    named = files(spark, sf_dir).select("id", "content").select(path.alias("path"), path.alias("relative_path"), F.lit(ext).alias("ext"), F.lit(language).alias("language"), content.alias("content"))
    return _flat(chunking.chunk_files(named, SIZE, OVERLAP, max_bytes=None))


_PY_HEAD, _PY_TAIL = "import os\n\n@cached\ndef first(a):\n    return a\n\nclass Second:\n    def third(self):\n", "\n        return 3\n"
_STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _nodes_sql(nodes: str, language: str, ext: str) -> str:
    """SQL of ``_flat`` for files whose syntax nodes are (path, k, first, last, text): those over the size are cut into runs of whole lines by a recursive walk."""
    return f"""WITH RECURSIVE {nodes}, lined AS (
  SELECT *, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM nodes
), sized AS (
  SELECT *, len(lines) AS n, list_transform(lines, lambda x, i: strlen(x) + CASE WHEN i < len(lines) THEN 1 ELSE 0 END) AS sizes FROM lined
), summed AS (
  SELECT *, list_transform(sizes, lambda x, i: list_sum(sizes[1:i])) AS upto FROM sized
), cut AS (
  SELECT path, k, 0::BIGINT AS piece, 0::BIGINT AS a, CASE WHEN strlen(text) <= {SIZE} THEN n ELSE greatest(1, len(list_filter(upto, lambda x: x <= {SIZE}))) END::BIGINT AS b FROM summed
  UNION ALL
  SELECT c.path, c.k, piece + 1, b, greatest(b + 1, len(list_filter(upto, lambda x: x <= upto[b] + {SIZE})))::BIGINT FROM cut c JOIN summed s ON c.path = s.path AND c.k = s.k WHERE b < n
), pieces AS (
  SELECT c.path, c.k, piece, CASE WHEN strlen(text) <= {SIZE} THEN text ELSE {_STRIPPED.format('array_to_string(lines[a + 1 : b], chr(10))')} END AS piece_text, first + a AS start_at,
    CASE WHEN strlen(text) <= {SIZE} THEN last ELSE first + b - 1 END AS end_line, CASE WHEN strlen(text) <= {SIZE} THEN c.k ELSE c.k * 1000 + piece END AS chunk_index, b = s.n AS final
  FROM cut c JOIN summed s ON c.path = s.path AND c.k = s.k
), tailed AS (
  SELECT *, hex(encode(piece_text)) AS h, strlen(piece_text)::BIGINT AS n FROM pieces WHERE piece_text <> '' OR NOT final
), leads AS (
  SELECT *, decode(unhex(substring(h, 2 * {_moved(f"greatest(n - {OVERLAP}, 0)", 1)} + 1))) AS tail FROM tailed
), led AS (
  SELECT *, lag(tail) OVER (PARTITION BY path ORDER BY k, piece) AS lead_text, sha256(path || ':' || start_at::VARCHAR || ':' || end_line::VARCHAR) AS id FROM leads
), fresh AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, piece) AS nth FROM led
)
SELECT id, path AS relative_path, CASE WHEN lead_text IS NULL THEN start_at ELSE greatest(0, start_at - {_LINES.format('lead_text')}) END::BIGINT AS start_line, end_line::BIGINT AS end_line, '{language}' AS language,
  row_number() OVER (PARTITION BY path ORDER BY k, piece) - 1 AS ord, '{ext}' AS file_extension, chunk_index::BIGINT AS chunk_index, sha256(piece_text) AS hash FROM fresh WHERE nth = 1"""


def _led_lines(lead: str) -> str:
    """SQL: ``text`` with ``lead`` before each of its lines; a line end at the end starts none, and an empty text has none."""
    return f"CASE WHEN text = '' THEN '' ELSE regexp_replace(rtrim(text, chr(10)), '(?m)^', {lead}, 'g') || repeat(chr(10), (length(text) - length(rtrim(text, chr(10))))::INT) END"


_PY_NODES = f"""bodies AS (
  SELECT '/corpus/python/' || doc_id::VARCHAR || '.py' AS path, {_led_lines("'        # '")} AS body FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT path, unnest([
    {{'k': 0, 'first': 3, 'text': '@cached' || chr(10) || 'def first(a):' || chr(10) || '    return a'}}, {{'k': 1, 'first': 4, 'text': 'def first(a):' || chr(10) || '    return a'}},
    {{'k': 2, 'first': 7, 'text': 'class Second:' || chr(10) || '    def third(self):' || chr(10) || body || chr(10) || '        return 3'}},
    {{'k': 3, 'first': 8, 'text': 'def third(self):' || chr(10) || body || chr(10) || '        return 3'}}
  ], recursive := true) FROM bodies
), nodes AS (SELECT *, first + length(text) - length(replace(text, chr(10), '')) AS last FROM placed)"""

_MD_NODES = f"""bodies AS (
  SELECT '/corpus/markdown/' || doc_id::VARCHAR || '.md' AS path, '# Document ' || doc_id::VARCHAR || chr(10) || {_led_lines("'\n## Part\n\n'")} AS body, text FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT *, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS parts, length(body) - length(replace(body, chr(10), '')) + 1 AS n_lines FROM bodies
), split AS (
  SELECT path, body, parts, n_lines, unnest(range(len(parts))) AS i FROM counted
), nodes AS (
  SELECT path, 0 AS k, 1 AS first, n_lines AS last, body AS text FROM counted
  UNION ALL SELECT path, 1, 1, 1, split_part(body, chr(10), 1) FROM counted
  UNION ALL SELECT path, 2 + 2 * i, 3 + 4 * i, CASE WHEN i + 1 < len(parts) THEN 7 + 4 * i ELSE n_lines END,
    '## Part' || chr(10) || chr(10) || parts[i + 1] || CASE WHEN i + 1 < len(parts) THEN chr(10) || chr(10) WHEN right(body, 1) = chr(10) AND parts[i + 1] <> '' THEN chr(10) WHEN right(body, 1) = chr(10) THEN right(body, n_lines::INT - (5 + 4 * i)::INT) ELSE '' END FROM split
  UNION ALL SELECT path, 3 + 2 * i, 3 + 4 * i, 3 + 4 * i, '## Part' FROM split
)"""


@query(_nodes_sql(_MD_NODES, "markdown", "md"))
def md_sections(spark, sf_dir):
    """Every document with a heading over each of its paragraphs."""
    body = F.regexp_replace("content", "(?m)^", "\n## Part\n\n")
    return _rewritten(spark, sf_dir, ".md", "markdown", F.concat(F.lit("# Document "), F.col("id").cast("string"), F.lit("\n"), body))


@query(_nodes_sql(_PY_NODES, "python", "py"))
def py_defs(spark, sf_dir):
    """Every document as a class whose method returns its lines as comments."""
    body = F.regexp_replace("content", "(?m)^", "        # ")
    return _rewritten(spark, sf_dir, ".py", "python", F.concat(F.lit(_PY_HEAD), body, F.lit(_PY_TAIL)))


# -- full text ---------------------------------------------------------------

_TOKENS_SQL = "toks AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) <= 39) AS w FROM documents)"
_STATS_SQL = f"{_TOKENS_SQL}, lens AS (SELECT id, len(w)::BIGINT AS dl FROM toks), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), flat AS (SELECT id, unnest(w) AS term FROM toks)"
_SCORE_SQL = "ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)))"


def _bm25_sql(terms) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    order = " + ".join(f"coalesce(max(CASE WHEN term = '{t}' THEN s END), 0e0)" for t in terms)
    return (
        f"{_STATS_SQL}, tf AS (SELECT id, term, count(*) AS tf FROM flat WHERE term IN ({listed}) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
        f"parts AS (SELECT tf.id, tf.term, {_SCORE_SQL} AS s FROM tf JOIN df USING (term) JOIN lens USING (id), stats), scored AS (SELECT id, round({order}, 6) AS score FROM parts GROUP BY id)"
    )


@query(f"WITH {_TOKENS_SQL}, flat AS (SELECT id, unnest(w) AS term FROM toks) SELECT id, term, count(*) AS tf FROM flat GROUP BY id, term")
def tokenize_tf(spark, sf_dir):
    return bm25.term_frequencies(texts(spark, sf_dir))


@query(f"WITH {_TOKENS_SQL} SELECT id, len(w)::BIGINT AS dl FROM toks")
def doc_lengths(spark, sf_dir):
    return bm25.document_lengths(texts(spark, sf_dir))


@query(f"WITH {_TOKENS_SQL}, flat AS (SELECT DISTINCT id, unnest(w) AS term FROM toks) SELECT term, count(*) AS df FROM flat GROUP BY term")
def term_df(spark, sf_dir):
    return bm25.document_frequencies(texts(spark, sf_dir))


@query(f"WITH {_bm25_sql(TERMS)} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT {CANDIDATES}")
def bm25_topk(spark, sf_dir):
    return bm25.top(bm25.scores(texts(spark, sf_dir), bm25.query_terms(QUERY)), CANDIDATES)


@query(f"WITH {_bm25_sql(TERMS)} SELECT id, least(greatest(score, 0e0), 1e0) AS score FROM scored ORDER BY scored.score DESC, id LIMIT {CANDIDATES}")
def bm25_clamped(spark, sf_dir):
    """Scores as they are shown; the order is that of the full scores."""
    return bm25_topk(spark, sf_dir).select("id", bm25.clamp(F.col("score")).alias("score"))


def _matching(spark, sf_dir, text: str) -> DataFrame:
    searcher = bm25.Searcher(texts(spark, sf_dir))
    return searcher.run(bm25.parse(text)).select("id")


_HAS = "SELECT id FROM toks WHERE list_contains(w, 'the') AND {0} list_contains(w, 'and')"


@query(f"WITH {_TOKENS_SQL} {_HAS.format('')}")
def bm25_and(spark, sf_dir):
    return _matching(spark, sf_dir, "the AND and")


@query(f"WITH {_TOKENS_SQL} {_HAS.format('NOT')}")
def bm25_not(spark, sf_dir):
    return _matching(spark, sf_dir, "the -and")


@query(
    f"WITH {_TOKENS_SQL}, flat AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM toks) SELECT DISTINCT a.id FROM flat a JOIN flat b ON a.id = b.id AND b.pos = a.pos + 1 "
    "WHERE a.term = 'of' AND b.term = 'the'"
)
def bm25_phrase(spark, sf_dir):
    return _matching(spark, sf_dir, '"of the"')


@query(
    f"WITH {_TOKENS_SQL}, flat AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM toks) SELECT DISTINCT a.id FROM flat a JOIN flat b ON a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 "
    "WHERE a.term = 'of' AND b.term = 'the'"
)
def bm25_slop(spark, sf_dir):
    return _matching(spark, sf_dir, '"of the"~2')


@query(f"WITH {_TOKENS_SQL} SELECT id FROM toks WHERE list_contains(w, 'die') OR list_contains(w, 'les')")
def bm25_in(spark, sf_dir):
    return _matching(spark, sf_dir, "IN [die les]")


@query(f"WITH {_TOKENS_SQL} SELECT id FROM toks WHERE len(list_filter(w, lambda t: t >= 'thea' AND t < 'thek')) > 0")
def bm25_range(spark, sf_dir):
    return _matching(spark, sf_dir, "[thea TO thek}")


@query(f"WITH {FILES_SQL} SELECT id FROM files WHERE path >= '/corpus/src1' AND path <= '/corpus/src2' OR path = '/corpus/src3/7.md'")
def bm25_field(spark, sf_dir):
    """A range and a term over a field that is no text."""
    searcher = bm25.Searcher(files(spark, sf_dir).select("id", "content", F.col("path").alias("file_path")))
    return searcher.run(bm25.parse("file_path:[/corpus/src1 TO /corpus/src2] OR file_path:/corpus/src3/7.md")).select("id")


@query("SELECT doc_id AS id, 1e0 AS score FROM documents")
def bm25_any(spark, sf_dir):
    return bm25.Searcher(texts(spark, sf_dir)).run(bm25.parse("*"))


@query(
    f"WITH {_STATS_SQL}, tf AS (SELECT id, term, count(*) AS tf FROM flat WHERE term IN ('the', 'and') GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    f"parts AS (SELECT tf.id, CASE tf.term WHEN 'the' THEN 2.5e0 ELSE 1e0 END * {_SCORE_SQL} AS s FROM tf JOIN df USING (term) JOIN lens USING (id), stats) "
    "SELECT id, round(sum(s), 5) AS score FROM parts GROUP BY id"
)
def bm25_boost(spark, sf_dir):
    found = bm25.Searcher(texts(spark, sf_dir)).run(bm25.parse("the^2.5 OR and"))
    return found.select("id", F.round("score", 5).alias("score"))


@query(
    f"WITH {_STATS_SQL}, asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) <= 39)) AS term FROM benchmark), "
    "tf AS (SELECT id, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    f"parts AS (SELECT tf.id, tf.term, {_SCORE_SQL} AS s FROM tf JOIN df USING (term) JOIN lens USING (id), stats), "
    "scored AS (SELECT query_id, id, round(sum(s), 6) AS score FROM parts JOIN asked USING (term) GROUP BY query_id, id), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) SELECT query_id, id, score, rank FROM ranked WHERE rank <= 10"
)
def bm25_multi(spark, sf_dir):
    """Every benchmark item as a query."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25.batch_scores(texts(spark, sf_dir), asked, 10).select("query_id", "id", "score", "rank")


@query(ORACLES["bm25_multi"])
def bm25_blockmax(spark, sf_dir):
    """The same through a stored index of block-max postings."""
    path = fresh_folder(spark, "blockmax")
    blockmax.write(blockmax.build(texts(spark, sf_dir)), path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return blockmax.top(spark.read.parquet(path), asked, 10).select("query_id", "id", "score", "rank")


# -- vectors -----------------------------------------------------------------

_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"


@query(f"SELECT vec_id AS id, {_COS.format('embedding', _Q0)} AS score FROM embeddings ORDER BY score DESC, id LIMIT {CANDIDATES}")
def cosine_topk(spark, sf_dir):
    return vector.top(vectors(spark, sf_dir), vector.query_vector(query_vector(spark, sf_dir)), CANDIDATES)


_BATCH_SQL = (
    f"pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)"
)


@query(f"WITH {_BATCH_SQL} SELECT query_id, id, score, rank FROM ranked WHERE rank <= 10")
def cosine_batch(spark, sf_dir):
    """The stated query set, every id divisible by 100, in one pass over all vectors."""
    v = vectors(spark, sf_dir)
    return vector.batch_top(v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 10).select("query_id", "id", "score", "rank")


@query(f"SELECT vec_id AS id, {_COS.format('embedding', _Q0)} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, id LIMIT {CANDIDATES}")
def cosine_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.top(rows, vector.query_vector(query_vector(spark, sf_dir)), CANDIDATES)


@query("SELECT vec_id AS id, len(embedding)::BIGINT AS n FROM embeddings")
def dimension_guard(spark, sf_dir):
    """All vectors pass the guard of the query vector's length."""
    return vector.guarded(vectors(spark, sf_dir), len(query_vector(spark, sf_dir))).select("id", F.size("vector").cast("long").alias("n"))


@query()
def ann_lsh_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    asked = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vector.lsh_top(v, asked, 10, len(query_vector(spark, sf_dir))).select("query_id", "id", "score", "rank")


@query()
def ann_graph_topk(spark, sf_dir):
    """The queries of ``cosine_batch`` through a graph of neighbours."""
    v = vectors(spark, sf_dir)
    asked = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return neighbour_graph.search(*neighbour_graph.build(v), asked, 10).top


@query("SELECT doc_id AS id, md5(CASE WHEN text = '' THEN ' ' WHEN strlen(text) > 2048 THEN substring(text, 1, 2048) ELSE text END) AS digest FROM documents")
def embed_preprocess(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.md5(embedding_input(F.col("content"), 512).cast("binary")).alias("digest"))


_DIM = 256
_HASH_SQL = (
    f"{_TOKENS_SQL}, tf AS (SELECT id, ('0x' || substring(md5(term), 1, 8))::BIGINT % {_DIM} AS bucket, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM toks) GROUP BY ALL), "
    "embedded AS (SELECT id, bucket, tf / sqrt((sum(tf * tf) OVER (PARTITION BY id))::DOUBLE) AS weight FROM tf)"
)


@query(f"WITH {_HASH_SQL} SELECT id, bucket, round(weight, 9) AS weight FROM embedded")
def hash_embed(spark, sf_dir):
    return vector.hash_embedding(texts(spark, sf_dir), _DIM).select("id", "bucket", F.round("weight", 9).alias("weight"))


@query(
    f"WITH {_HASH_SQL}, asked AS (SELECT ('0x' || substring(md5(term), 1, 8))::BIGINT % {_DIM} AS bucket, count(*) / sqrt(3e0) AS q FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in TERMS)}) t(term) GROUP BY ALL) "
    f"SELECT id, round(sum(weight * q), 6) AS score FROM embedded JOIN asked USING (bucket) GROUP BY id ORDER BY score DESC, id LIMIT {CANDIDATES}"
)
def hash_embed_search(spark, sf_dir):
    asked = vector.hash_embedding(spark.createDataFrame([(0, QUERY)], "id long, content string"), _DIM)
    return vector.sparse_top(vector.hash_embedding(texts(spark, sf_dir), _DIM), asked, CANDIDATES)


@query(
    f"WITH {_TOKENS_SQL.replace('lower(text)', 'lower(CASE WHEN strlen(text) > 32768 THEN substring(text, 1, 32768) ELSE text END)')}, "
    "tf AS (SELECT id, ('0x' || substring(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(w) AS term FROM toks) GROUP BY ALL), "
    "grid AS (SELECT d.doc_id AS id, b.range AS bucket FROM documents d, range(64) b), filled AS (SELECT g.id, g.bucket, coalesce(t.tf, 0) AS tf FROM grid g LEFT JOIN tf t ON g.id = t.id AND g.bucket = t.bucket), "
    "sized AS (SELECT *, sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS size FROM filled) "
    "SELECT id, list((CASE WHEN size > 0 THEN tf / size ELSE 0 END)::FLOAT ORDER BY bucket) AS vector FROM sized GROUP BY id"
)
def embed_provider(spark, sf_dir):
    """Dense vectors from the local provider, through the batched worker path, which cuts texts as every provider does."""
    return texts(spark, sf_dir).select("id", embedding(HashingEmbedder(64), F.col("content")).alias("vector"))


# -- fusion ------------------------------------------------------------------

_LEGS_SQL = (
    f"{_bm25_sql(TERMS)}, text_leg AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT {CANDIDATES}), "
    f"vector_leg AS (SELECT vec_id AS id, {_COS.format('embedding', _Q0)} AS score FROM embeddings ORDER BY score DESC, id LIMIT {CANDIDATES}), "
    "every AS (SELECT id, 1e0 / (100 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM text_leg UNION ALL SELECT id, 1e0 / (100 + row_number() OVER (ORDER BY score DESC, id)) FROM vector_leg), "
    "fused AS (SELECT id, round(sum(part), 9) AS score, count(*) AS legs FROM every GROUP BY id)"
)


def _fused(spark, sf_dir) -> DataFrame:
    return fusion.fuse([bm25_topk(spark, sf_dir), cosine_topk(spark, sf_dir)], RRF_K)


@query(f"WITH {_LEGS_SQL} SELECT id, score, legs FROM fused ORDER BY score DESC, id LIMIT 10")
def rrf_fuse(spark, sf_dir):
    """The flagship: both legs' candidates, fused, the best ten."""
    return fusion.fused_top(_fused(spark, sf_dir), 10)


@query(f"WITH {_LEGS_SQL} SELECT id, score, legs, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fused")
def rrf_topk(spark, sf_dir):
    return fusion.with_rank(_fused(spark, sf_dir), 2 * CANDIDATES)


_PLACED_SQL = f"{FILES_SQL}, {_LEGS_SQL}, placed AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fused)"


def _found(spark, sf_dir, extensions=None, limit=10) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    chunks = files(spark, sf_dir).join(labelled, "id", "left_semi").withColumn("file_path", F.col("path"))
    return fusion.lookup(rrf_topk(spark, sf_dir).select("id", "score", "rank"), chunks, extensions, limit)


@query(f"WITH {_PLACED_SQL} SELECT id, rank, score, path FROM placed JOIN files USING (id) WHERE id IN (SELECT doc_id FROM labels) ORDER BY rank LIMIT 10")
def hybrid_lookup(spark, sf_dir):
    """Ranks come before the lookup, here in the labelled documents; ids it misses leave gaps."""
    return _found(spark, sf_dir).select("id", "rank", "score", "path")


@query(f"WITH {_PLACED_SQL} SELECT id, rank, score, path FROM placed JOIN files USING (id) WHERE id IN (SELECT doc_id FROM labels) AND ext IN ('.py', '.rs') ORDER BY rank LIMIT 10")
def hybrid_ext_filter(spark, sf_dir):
    return _found(spark, sf_dir, [".py", ".rs"]).select("id", "rank", "score", "path")


@query(
    f"WITH {_STATS_SQL}, asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) <= 39)) AS term FROM benchmark), "
    "tf AS (SELECT id, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    f"parts AS (SELECT tf.id, tf.term, {_SCORE_SQL} AS s FROM tf JOIN df USING (term) JOIN lens USING (id), stats), "
    "scored AS (SELECT query_id, id, round(sum(s), 6) AS score FROM parts JOIN asked USING (term) GROUP BY query_id, id), "
    f"text_leg AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored QUALIFY r <= {CANDIDATES}), "
    f"pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT item_id FROM benchmark)), "
    f"vector_leg AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM pairs QUALIFY r <= {CANDIDATES}), "
    "every AS (SELECT query_id, id, 1e0 / (100 + r) AS part FROM text_leg UNION ALL SELECT query_id, id, 1e0 / (100 + r) FROM vector_leg), "
    "fused AS (SELECT query_id, id, round(sum(part), 9) AS score, count(*) AS legs FROM every GROUP BY query_id, id) "
    "SELECT query_id, id, score, legs, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10"
)
def hybrid_multi(spark, sf_dir):
    """All benchmark items as queries at once, each with the vector of the same number."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    text_leg = bm25.batch_scores(texts(spark, sf_dir), asked, CANDIDATES).select("query_id", "id", "score")
    v = vectors(spark, sf_dir)
    vector_leg = vector.batch_top(v, v.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), CANDIDATES).select("query_id", "id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    fused = fusion.fuse([text_leg, vector_leg], RRF_K, per="query_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 10")


# a character's last byte is found by cutting 0 to 3 bytes back; DuckDB counts characters instead
_SNIPPET_SQL = (
    "CASE WHEN strlen(content) <= 5000 THEN content ELSE (SELECT max(substring(content, 1, n)) FROM (SELECT content AS c, unnest(range(1250, 5001)) AS n) "
    "WHERE strlen(substring(c, 1, n)) <= 5000) || '...' || chr(10) || '[Content truncated]' END"
)


@query(f"WITH {FILES_SQL}, shown AS (SELECT id, {_SNIPPET_SQL} AS shown FROM files) SELECT id, md5(shown) AS digest, strlen(shown)::BIGINT AS n_bytes FROM shown")
def snippet_truncate(spark, sf_dir):
    shown = files(spark, sf_dir).select("id", fusion.snippet(F.col("content")).alias("shown"))
    return shown.select("id", F.md5(F.col("shown").cast("binary")).alias("digest"), F.octet_length("shown").cast("long").alias("n_bytes"))


@query(
    f"WITH {_PLACED_SQL}, found AS (SELECT id, rank, ext, relative_path, content FROM placed JOIN files USING (id) WHERE id IN (SELECT doc_id FROM labels) ORDER BY rank LIMIT 10), "
    f"shown AS (SELECT *, {_SNIPPET_SQL} AS shown, row_number() OVER (ORDER BY rank) AS display_rank, CASE ext WHEN '.md' THEN 'markdown' WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' ELSE 'unknown' END AS language, {_LINES.format('content')} AS n FROM found) "
    "SELECT rank, display_rank, display_rank::VARCHAR || '. Code snippet (' || language || ') [corpus]' || chr(10) || '   Location: ' || relative_path || ':1-' || n::VARCHAR || chr(10) || '   Rank: ' || display_rank::VARCHAR "
    "|| chr(10) || '   Context: ' || chr(10) || '```' || language || chr(10) || shown || chr(10) || '```' || chr(10) AS text FROM shown"
)
def format_results(spark, sf_dir):
    found = _found(spark, sf_dir).withColumn("start_line", F.lit(1).cast("long")).withColumn("end_line", line_count(F.col("content")))
    return fusion.result_text(found, "corpus")


# -- sync --------------------------------------------------------------------

_STATES_SQL = (
    f"{FILES_SQL}, old AS (SELECT relative_path, sha256(content) AS hash FROM files WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), "
    "new AS (SELECT relative_path, sha256(CASE WHEN ext = '.rs' THEN content || '!' ELSE content END) AS hash FROM files WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"
)
_DIFF_SQL = (
    "changes AS (SELECT coalesce(o.relative_path, n.relative_path) AS relative_path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'modified' END AS change "
    "FROM old o FULL JOIN new n ON o.relative_path = n.relative_path WHERE o.hash IS DISTINCT FROM n.hash)"
)


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: the old one has no documents of low quality, the new one no toxic ones, and Rust files were edited."""
    own = files(spark, sf_dir).select("id", "relative_path", "ext", "content")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    edited = F.when(F.col("ext") == ".rs", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    old = own.join(labels.filter("quality = 0"), "id", "left_anti")
    new = own.join(labels.filter("toxic = 1"), "id", "left_anti").withColumn("content", edited)
    return sync.file_hashes(old), sync.file_hashes(new)


@query(f"WITH {_STATES_SQL} SELECT relative_path, hash FROM old")
def file_hashes(spark, sf_dir):
    return _states(spark, sf_dir)[0]


@query(f"WITH {_STATES_SQL} SELECT sha256(relative_path || ':' || hash) AS node, relative_path || ':' || hash AS data FROM old")
def merkle_leaves(spark, sf_dir):
    return sync.merkle_leaves(_states(spark, sf_dir)[0])


@query(
    f"WITH {_STATES_SQL}, groups AS (SELECT substring(sha256(relative_path), 1, 3) AS g, sha256(string_agg(hash, '' ORDER BY relative_path)) AS h, count(*) AS n FROM old GROUP BY g) "
    "SELECT sha256(string_agg(h, '' ORDER BY g)) AS root, sum(n)::BIGINT AS files FROM groups"
)
def merkle_root(spark, sf_dir):
    return sync.merkle_root(_states(spark, sf_dir)[0])


@query(
    f"WITH {_STATES_SQL}, a AS (SELECT sha256(relative_path || ':' || hash) AS node FROM old), b AS (SELECT sha256(relative_path || ':' || hash) AS node FROM new) "
    "SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.node = b.node WHERE a.node IS NULL OR b.node IS NULL"
)
def dag_compare(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    return sync.compare_dags(sync.merkle_leaves(old), sync.merkle_leaves(new))


@query(f"WITH {_STATES_SQL}, nodes AS (SELECT relative_path || ':' || hash AS data FROM old) SELECT 'child' AS part, data FROM nodes UNION ALL SELECT 'leaf', data FROM nodes UNION ALL SELECT 'root', 'root'")
def dag_parts(spark, sf_dir):
    """The root, its children and the leaves of the tree over the old state."""
    nodes = sync.merkle_nodes(_states(spark, sf_dir)[0])
    root = sync.roots(nodes)
    parts = (("child", nodes.join(root.select(F.col("node").alias("parent")), "parent", "left_semi")), ("leaf", sync.leaves(nodes)), ("root", root))
    named = [df.select(F.lit(name).alias("part"), "data") for name, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


#: DuckDB: the states with a folder for each digit of the document's number.
_DEEP_SQL = (
    "deep_{0} AS (SELECT regexp_replace(relative_path, '/.*', '') || '/' || regexp_replace(regexp_extract(relative_path, '/([0-9]+)', 1), '(.)', '\\1/', 'g') || "
    "regexp_replace(relative_path, '.*/', '') AS relative_path, hash FROM {0})"
)


def _deep(state: DataFrame) -> DataFrame:
    """A state of the corpus with a folder for each digit of the document's number."""
    digits = F.regexp_replace(F.regexp_extract("relative_path", "/([0-9]+)", 1), "(.)", "$1/")
    path = F.concat(F.substring_index("relative_path", "/", 1), F.lit("/"), digits, F.substring_index("relative_path", "/", -1))
    return state.select(path.alias("relative_path"), "hash")


@query(
    f"WITH RECURSIVE {_STATES_SQL}, {_DEEP_SQL.format('old')}, "
    "own AS (SELECT relative_path AS node, 'file' AS kind, hash, len(string_split(relative_path, '/')) - 1 AS level FROM deep_old), "
    "inner_nodes AS (SELECT NULL::VARCHAR AS node, 'none' AS kind, NULL::VARCHAR AS hash, (SELECT max(level) FROM own) + 1 AS level "
    "UNION ALL SELECT node, 'folder', sha256(string_agg(fan || hash, '' ORDER BY fan)), level FROM ("
    "SELECT node, level, fan, sha256(string_agg(part, '' ORDER BY part)) AS hash FROM ("
    "SELECT regexp_replace(child, '/?[^/]*$', '') AS node, level, substring(sha256(regexp_replace(child, '.*/', '')), 1, 3) AS fan, substring(kind, 1, 2) || sha256(regexp_replace(child, '.*/', '')) || hash AS part "
    "FROM (SELECT node AS child, kind, hash, level - 1 AS level FROM inner_nodes WHERE kind = 'folder' AND level > 0 "
    "UNION ALL SELECT own.node, own.kind, own.hash, own.level FROM own WHERE own.level = (SELECT max(level) - 1 FROM inner_nodes))) GROUP BY node, level, fan) GROUP BY node, level) "
    "SELECT node, kind, hash FROM inner_nodes WHERE kind = 'folder' UNION ALL SELECT node, kind, hash FROM own"
)
def folder_hashes(spark, sf_dir):
    """Hashes of all folders and files, from the deepest up."""
    return folder_tree.build(spark, _deep(_states(spark, sf_dir)[0])).nodes()


@query(
    f"WITH {_STATES_SQL.replace('old AS', 'flat_old AS').replace('new AS', 'flat_new AS')}, {_DEEP_SQL.format('flat_old')}, {_DEEP_SQL.format('flat_new')}, "
    f"old AS (SELECT * FROM deep_flat_old), new AS (SELECT * FROM deep_flat_new), {_DIFF_SQL} SELECT relative_path, change FROM changes"
)
def folder_diff(spark, sf_dir):
    """Changed files, found by descending from the roots of two trees through what is unlike."""
    old, new = (folder_tree.build(spark, _deep(state)) for state in _states(spark, sf_dir))
    return folder_tree.compare(old, new)[0]


@query(f"WITH {_STATES_SQL}, {_DIFF_SQL} SELECT relative_path, change FROM changes")
def diff_states(spark, sf_dir):
    return sync.diff(*_states(spark, sf_dir))


@query(f"WITH {_STATES_SQL} SELECT relative_path, hash FROM new")
def apply_changes(spark, sf_dir):
    """Applying the differences to the old state gives the new one."""
    old, new = _states(spark, sf_dir)
    return sync.apply_changes(old, new, sync.diff(old, new))


@query(f"WITH {FILES_SQL} SELECT id, relative_path FROM files WHERE source NOT IN ('src1', 'src2')")
def delete_by_file(spark, sf_dir):
    own = files(spark, sf_dir).select("id", "relative_path", "source")
    gone = own.filter(F.col("source").isin("src1", "src2")).select("relative_path")
    return sync.delete(own, gone, "relative_path").select("id", "relative_path")


@query(
    "WITH fresh AS (SELECT DISTINCT doc_id AS id, 'new' AS state FROM labels UNION ALL SELECT page_id + 1000000, 'new' FROM pages) "
    "SELECT doc_id AS id, 'old' AS state FROM documents WHERE doc_id NOT IN (SELECT id FROM fresh) UNION ALL SELECT id, state FROM fresh"
)
def upsert_chunks(spark, sf_dir):
    """Labelled documents replace those of equal id; pages are added."""
    ids = texts(spark, sf_dir).select("id")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    fresh = labelled.unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000).alias("id"))).withColumn("state", F.lit("new"))
    return sync.upsert(ids.withColumn("state", F.lit("old")), fresh)


@query(
    "SELECT e.event_id AS ordinal, e.user_id AS id, d.source FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id"
)
def batch_lookup(spark, sf_dir):
    """What each event names, in its order, with nulls where nothing is found."""
    wanted = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("id"))
    return sync.lookup_batch(files(spark, sf_dir).select("id", "source"), wanted).select("ordinal", "id", "source")


@query(
    f"WITH {FILES_SQL}, cut AS (SELECT {_CUT} AS n FROM files WHERE length(content) > 0) "
    "SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(n)::BIGINT FROM cut) AS chunks, (SELECT count(*) FROM embeddings) AS vectors"
)
def store_counts(spark, sf_dir):
    chunks = chunking.char_chunks(files(spark, sf_dir).select("id", "content"), SIZE, OVERLAP)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(files(spark, sf_dir), "files").crossJoin(count(chunks, "chunks")).crossJoin(count(vectors(spark, sf_dir), "vectors"))


@query(
    "WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'indexfailed' WHEN 'view' THEN 'indexing' ELSE 'indexed' END AS status, user_id AS files, event_id AS chunks, value AS percentage FROM events), "
    "p AS (SELECT *, CASE WHEN status = 'indexed' THEN 'ready' WHEN status = 'indexfailed' THEN 'failed' WHEN percentage < 10 THEN 'scanning' ELSE 'embedding' END AS phase FROM s) "
    "SELECT status, phase, count(*) AS codebases, coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(chunks), 0)::BIGINT AS chunks FROM p GROUP BY status, phase"
)
def status_summary(spark, sf_dir):
    """Codebases by status and phase; events stand for the status of one each."""
    status = F.when(F.col("event_type") == "error", "indexfailed").when(F.col("event_type") == "view", "indexing").otherwise("indexed")
    rows = table(spark, sf_dir, "events").select(status.alias("status"), F.col("user_id").alias("files"), F.col("event_id").alias("chunks"), F.col("value").alias("percentage"))
    phase = F.when(F.col("status") == "indexed", "ready").when(F.col("status") == "indexfailed", "failed").when(F.col("percentage") < 10, "scanning").otherwise("embedding")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("status", phase.alias("phase")).agg(F.count("*").alias("codebases"), total("files"), total("chunks"))


__all__ = ["ORACLES", "QUERIES", "as_double", "cosine", "tokens"]
