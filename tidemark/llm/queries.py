"""The queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    from tidemark.llm import token_files

    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, rn, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)
), items AS (
  SELECT item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS width,
         array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM items, UNNEST(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i)
  WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT rn, i, width, array_to_string(w[i : i + width - 1], ' ') AS gram
  FROM words, widths, UNNEST(range(1, len(w) - width + 2)) AS t(i)
  WHERE len(w) >= width
), found AS (
  SELECT rn, i, width, item FROM places JOIN windows USING (width, gram)
), hit AS (
  SELECT rn, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT rn, i, width FROM found) AS f, UNNEST(range(i, i + width)) AS t(p)
  GROUP BY rn
), named AS (
  SELECT rn, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rn, item FROM found) GROUP BY rn
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""


@query("op10_decontaminate", OP10_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, from suffix arrays of the documents."""
    from tidemark.llm import decontaminate

    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts decoded from them, as digests."""
    from tidemark.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression with dictionaries of the other folds."""
    from tidemark.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    contents = langid.dictionaries(docs.where(~langid.held_out()))
    texts = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(texts, contents).drop("text")


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by patterns and by character models."""
    from tidemark.llm import secrets

    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(docs))


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document under five-word Jaccard similarity, with its links."""
    from tidemark.llm import ngram_join

    return ngram_join.classify(table(spark, sf_dir, "documents"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from tidemark.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tidemark.llm import pages

    return pages.main_text(table(spark, sf_dir, "pages"))


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how much of each kind."""
    from tidemark.llm import surrogates

    # The fixed key is for trials, whose results are to be the same each time.
    key = spark.conf.get("spark.tidemark.surrogates.key", "a key for trials")
    return surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), key, counts=True)


@query("op4_neighbours")
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    from tidemark.llm import neighbours

    return neighbours.search(table(spark, sf_dir, "embeddings"), "pmod(id, 50) = 0")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every document in groups over the same bytes, with their links' counts."""
    from tidemark.llm import alignment

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(table(spark, sf_dir, "documents"), *paths)


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


OP12_SQL = f"""
WITH RECURSIVE crcs AS (
  -- crc32 bit by bit: a byte is mixed in, then eight shifts follow.
  SELECT *, xor(list_reduce(
      flatten([[4294967295]] || list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END
    ), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN crc % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM crcs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), tree(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1
), upper(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM upper WHERE n > 1 GROUP BY lvl, pos // 2, n
), siblings AS (
  -- A node that is alone in its run has none, and is hashed all the same.
  SELECT rid, o.lvl AS step, t.h, t.pos < o.pos AS on_left
  FROM placed AS p
  JOIN tree AS o ON o.lang IS NOT DISTINCT FROM p.lang AND o.pos = p.pos >> o.lvl AND o.n > 1
  LEFT JOIN tree AS t ON t.lang IS NOT DISTINCT FROM o.lang AND t.lvl = o.lvl AND t.pos = xor(o.pos, 1)
  UNION ALL
  SELECT rid, 1000 + o.lvl, u.h, u.pos < o.pos
  FROM placed AS p JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM p.lang
  JOIN upper AS o ON o.pos = s.pos >> o.lvl AND o.n > 1
  LEFT JOIN upper AS u ON u.lvl = o.lvl AND u.pos = xor(o.pos, 1)
), proofs AS (
  SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256,
         list(CASE WHEN on_left THEN h || '.' ELSE '.' || coalesce(h, '') END ORDER BY step) AS path
  FROM siblings GROUP BY rid
), folded AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
         coalesce(proof_sha256, sha256('')) AS proof_sha256,
         list_reduce([coalesce(p.changed, p.leaf)] || coalesce(path, []),
                     lambda a, x: sha256(replace(x, '.', a))) AS folded_root
  FROM placed AS p JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proofs USING (rid)
)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op12_manifest", OP12_SQL)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of all documents, checked after tampering with some."""
    from tidemark.llm import manifest

    return manifest.report(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rn, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split, UNNEST(range(1, len(ls) + 1)) AS t(i)
), repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT rn, doc_id, i, line, last IS NOT NULL AND last <> doc_id AS gone FROM lines LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rn, doc_id
"""


@query("op13_line_dedup", OP13_SQL)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the long lines that other documents hold too."""
    from tidemark.llm import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents"))
