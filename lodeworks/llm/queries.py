"""The registered queries of the operators, over the whole given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if there is one."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances from the language's references and verdict per document."""
    from lodeworks.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    END) AS s FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b
  ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, low) AS (
  SELECT a, a FROM ends UNION SELECT b.b, r.low FROM reach r JOIN ends b ON b.a = r.node
  WHERE r.low < b.b),
lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id,
  d.doc_id = coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest ON node = d.doc_id
"""


@query(NEAR_DUPLICATE_SQL)
def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component and survivor flag per document."""
    from lodeworks.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM tokens WHERE len(w) >= 35)),
again AS (
  SELECT doc_id, p FROM windows SEMI JOIN (
    SELECT s FROM windows GROUP BY s HAVING count(*) > 1) r ON windows.s = r.s),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (
  SELECT doc_id, unnest(range(p, p + 35)) AS i FROM again) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(
    range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM tokens t LEFT JOIN gone ON gone.doc_id = t.doc_id
"""


@query(SUBSTRING_SQL)
def op6_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated 35-word windows take from each document, and what is left."""
    from lodeworks.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text per document."""
    import public_tokenizers

    from lodeworks.llm.bpe import token_digests

    return token_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op2_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document among 64 shards."""
    from lodeworks.llm.sharding import place

    shards = [f"shard-{i:03d}" for i in range(64)]
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return place(documents, ["doc_id"], shards)


WARC_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
parts AS (SELECT *, list_transform(range(0, 8), lambda i:
    ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS p FROM hashed),
coded AS (SELECT page_id, html, array_to_string(list_transform(p, lambda v: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1))), '') AS d FROM parts),
first AS (SELECT d, max(page_id) AS top FROM coded GROUP BY d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, c.d AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM coded c JOIN first f ON c.d = f.d
"""


@query(WARC_SQL)
def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back through the index."""
    from lodeworks.llm.warc import read_records, write_archives

    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or re-parameterised."""
    from lodeworks.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each page, trigrams learnt from all documents."""
    from lodeworks.llm.langid import identify, train

    return identify(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))


@query()
def op9_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate secrets of all documents with the forest's verdict."""
    from lodeworks.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query()
def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict per document."""
    from lodeworks.llm.toxicity import grade_documents, train

    documents = table(spark, sf_dir, "documents")
    return grade_documents(documents, train(documents, table(spark, sf_dir, "labels")))


@query()
def op11_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide link counts of two tokenizers per document."""
    import public_tokenizers

    from lodeworks.llm.alignment import align_documents

    return align_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), digests=True)


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p
    FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30),
cuts AS (
  SELECT *, array_to_string(w[:c], ' ') AS one, array_to_string(w[c + 1:], ' ') AS two FROM (
    SELECT *, unnest(range(1, k)) AS c FROM often WHERE k > 1)),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, c.c, x.f AS l, y.f AS r,
    CAST(2000000 * c.f::HUGEINT // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.one
  JOIN often y ON y.lang = c.lang AND y.phrase = c.two),
worst AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, sub, max(f) AS f FROM (
    SELECT lang, f, array_to_string(w[p:p + s - 1], ' ') AS sub FROM (
      SELECT *, unnest(range(1, k - s + 2)) AS p FROM (
        SELECT *, unnest(range(2, k)) AS s FROM often WHERE k > 2))) GROUP BY ALL),
left_over AS (
  SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.sub = w.phrase
  WHERE i.f IS NULL OR 100 * i.f < 80 * w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM left_over)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang
WHERE rank <= 2000
"""


@query(COLLOCATION_SQL)
def op12_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scoring phrases of two to four words of each language."""
    from lodeworks.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query()
def op13_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear log10 probability of every text."""
    from lodeworks.llm.neural_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))
