"""One query per operator, over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .consistent_phrases import compare_with_next
from .exact_shuffle import shard_digest, shuffle_to_shards
from .kmeans_tree import nearest
from .length_histogram import context_answers, encoded_lengths, length_histogram
from .license_templates import scan_licenses
from .merkle_manifest import manifest_digest
from .piece_rounds import encode_pieces, piece_digest
from .positional_index import find_passages, passage_digest
from .record_files import record_digest, token_records
from .rule_ensemble import judge_quality
from .shared import table
from .simhash import near_duplicates
from .url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


BYTE_PAIRS = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op1_url_filter(spark: SparkSession, root: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, root, "pages").select("page_id", "url"), rules).drop("url")


SQL["op1_url_filter"] = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rests
),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""


@query
def op2_positional_index(spark: SparkSession, root: str) -> DataFrame:
    return passage_digest(find_passages(table(spark, root, "documents"), table(spark, root, "benchmark")))


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL["op2_positional_index"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS t
  FROM items, UNNEST(range(greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0
),
runs AS (
  SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS t
  FROM docs, (SELECT DISTINCT n FROM windows) AS sizes, UNNEST(range(len(w) - n + 1)) AS u(i)
),
hits AS (SELECT r, i, n, item FROM runs JOIN windows USING (n, t)),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), UNNEST(range(n)) AS u(k) GROUP BY r
),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


@query
def op3_token_records(spark: SparkSession, root: str) -> DataFrame:
    return record_digest(token_records(table(spark, root, "documents"), BYTE_PAIRS))


@query
def op4_rule_ensemble(spark: SparkSession, root: str) -> DataFrame:
    return judge_quality(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op5_simhash(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "documents"))


@query
def op6_piece_rounds(spark: SparkSession, root: str) -> DataFrame:
    return piece_digest(encode_pieces(table(spark, root, "documents").select("doc_id", "text"), PIECES))


@query
def op7_length_histogram(spark: SparkSession, root: str) -> DataFrame:
    return context_answers(length_histogram(encoded_lengths(table(spark, root, "documents"), BYTE_PAIRS)))


@query
def op8_license_templates(spark: SparkSession, root: str) -> DataFrame:
    return scan_licenses(table(spark, root, "documents")).drop("notices")


@query
def op9_exact_shuffle(spark: SparkSession, root: str) -> DataFrame:
    return shard_digest(shuffle_to_shards(table(spark, root, "documents").select("doc_id", "text")))


@query
def op10_kmeans_tree(spark: SparkSession, root: str) -> DataFrame:
    return nearest(table(spark, root, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_consistent_phrases(spark: SparkSession, root: str) -> DataFrame:
    return compare_with_next(table(spark, root, "documents"))


@query
def op12_stripe_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations(table(spark, root, "documents"))


SQL["op12_stripe_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    UNNEST(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
f AS (
  SELECT lang, m, phrase, count(*) AS f
  FROM (
    SELECT lang, m, array_to_string(w[i + 1 : i + m], ' ') AS phrase
    FROM worded, UNNEST(range(1, 6)) AS sizes(m), UNNEST(range(len(w) - m + 1)) AS places(i)
  )
  GROUP BY lang, m, phrase
),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, n, k, x.f AS l, y.f AS r, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM candidates AS c JOIN totals USING (lang), UNNEST(range(1, m)) AS u(k)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[: k], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 :], ' ')
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT DISTINCT lang, a AS most, array_to_string(w[i + 1 : i + size], ' ') AS phrase
  FROM candidates, UNNEST(range(2, m)) AS s(size), UNNEST(range(m - size + 1)) AS p(i)
),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN (SELECT lang, phrase, max(most) AS most FROM inner_parts GROUP BY lang, phrase) USING (lang, phrase)
  WHERE most IS NULL OR 100 * most < 100 * a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query
def op13_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    return manifest_digest(table(spark, root, "documents"))


def _leaf_sql(*values: str) -> str:
    text = [f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || ({v}), '-')" for v in values]
    return f"sha256({' || '.join(text)})"


SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE seen AS (
  SELECT doc_id, lang,
    {_leaf_sql('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND coalesce(xor(list_reduce(
      list_prepend(4294967295::BIGINT,
        flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT + 256, 0, 0, 0, 0, 0, 0, 0]))),
      lambda crc, x: CASE WHEN xor(crc, greatest(x - 256, 0)) & 1 = 1
        THEN xor(xor(crc, greatest(x - 256, 0)) >> 1, 3988292384) ELSE xor(crc, greatest(x - 256, 0)) >> 1 END
    ), 4294967295) % 7 = 0, false) THEN {_leaf_sql('doc_id', 'source', 'lang', 'n_chars + 1', 'text')} END AS other
  FROM documents
),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, leaf, other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM seen
),
nodes(lang, level, i, h, n) AS (
  SELECT lang, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2
),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops(level, i, h, n) AS (
  SELECT 0, i, h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2
),
steps AS (
  SELECT r, own.level AS k, own.i % 2 AS side, sibling.h
  FROM leaves JOIN nodes AS own ON own.lang IS NOT DISTINCT FROM leaves.lang AND own.i = leaves.i >> own.level AND own.n > 1
  LEFT JOIN nodes AS sibling ON sibling.lang IS NOT DISTINCT FROM own.lang AND sibling.level = own.level AND sibling.i = xor(own.i, 1)
  UNION ALL
  SELECT r, 1000 + own.level, own.i % 2, sibling.h
  FROM leaves JOIN subroots ON subroots.lang IS NOT DISTINCT FROM leaves.lang
  JOIN tops AS own ON own.i = subroots.i >> own.level AND own.n > 1
  LEFT JOIN tops AS sibling ON sibling.level = own.level AND sibling.i = xor(own.i, 1)
),
proofs AS (
  SELECT r, list(CASE WHEN h IS NULL THEN '-' WHEN side = 1 THEN '<' || h ELSE '>' || h END ORDER BY k) AS path,
    coalesce(string_agg(h, '' ORDER BY k), '') AS siblings
  FROM steps GROUP BY r
),
roots AS (
  SELECT leaves.*, subroots.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(siblings, '') AS siblings,
    list_reduce(list_prepend(coalesce(other, leaf), coalesce(path, [])), lambda own, s: CASE s[1]
      WHEN '<' THEN sha256(s[2:] || own) WHEN '>' THEN sha256(own || s[2:]) ELSE sha256(own) END) AS folded_root
  FROM leaves JOIN subroots ON subroots.lang IS NOT DISTINCT FROM leaves.lang LEFT JOIN proofs USING (r)
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, lang, i AS place, folded_root = root AS verified FROM roots
"""
