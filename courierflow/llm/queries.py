"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.llm.common import table
from courierflow.llm.exact_dedup import exact_dedup
from courierflow.llm.license_scan import license_scan
from courierflow.llm.line_dedup import MIN_WORDS, line_dedup
from courierflow.llm.mixing import DRAW_MEAN, DRAW_TERMS, mix_sources
from courierflow.llm.near_dup import near_duplicates
from courierflow.llm.nearest import nearest
from courierflow.llm.packing import pack
from courierflow.llm.pii import find_personal_data, span_digest
from courierflow.llm.prefix_trie import conversation_trie
from courierflow.llm.quality import classify
from courierflow.llm.token_counts import token_counts
from courierflow.llm.token_files import token_files
from courierflow.llm.vector_codes import vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return keep


@_register("op4_exact_dedup", sql=r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM n JOIN g USING (text_sha256)""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@_register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


@_register("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.label, s.first_word, s.last_word)), ",")
    return license_scan(table(spark, sf_dir, "documents")).withColumn("spans", spans)


@_register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


MIX_SEED, MIX_POWER = 7, 0.5


@_register("op7_mixing", sql=f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, ((SELECT sum(n) FROM counts) / (SELECT sum(pow(n::DOUBLE, {MIX_POWER})) FROM counts)) * pow(n::DOUBLE, {MIX_POWER}) / n AS rate FROM counts),
parts AS (SELECT source, rate, greatest(ceil(rate / {DRAW_MEAN}), 1)::INT AS m FROM rates),
terms AS (SELECT source, 0 AS k, exp(-(rate / m)) AS term, exp(-(rate / m)) AS total FROM parts
          UNION ALL
          SELECT t.source, k + 1, term * (rate / m) / (k + 1), total + term * (rate / m) / (k + 1)
          FROM terms t JOIN parts p ON t.source IS NOT DISTINCT FROM p.source WHERE k < {DRAW_TERMS}),
inverse AS (SELECT source, list(total ORDER BY k) AS steps FROM terms GROUP BY source),
drawn AS (SELECT d.*, rate, (
            SELECT sum(len(list_filter(steps, lambda c: c <= ('0x' || substr(md5(concat('{MIX_SEED}:', coalesce(doc_id::VARCHAR, ''), ':', j)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))
            FROM unnest(range(1, m + 1)) AS draws(j))::INT AS n_copies
          FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN inverse i ON d.source IS NOT DISTINCT FROM i.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1))::INT AS copy, n_copies, rate FROM drawn WHERE n_copies > 0""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), power=MIX_POWER, seed=MIX_SEED)


@_register("op9_nearest")
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), query_step=20, k=20)


@_register("op3_line_dedup", sql=rf"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
split AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM raw),
keyed AS (SELECT doc_id, no, trim(line, E' 	
') AS line FROM split),
lines AS (SELECT doc_id, no, line, len(regexp_split_to_array(line, '\s+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS n FROM keyed WHERE line <> ''),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM lines),
windows AS (
  SELECT a.doc_id, a.n AS i, min(b.n) AS j FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + {MIN_WORDS}
  WHERE b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.n), b.n FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + {MIN_WORDS}
  WHERE b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.n),
content AS (SELECT x.doc_id, i, j, string_agg(line, chr(10) ORDER BY n) AS body FROM windows x JOIN lines l ON l.doc_id = x.doc_id AND n BETWEEN i AND j GROUP BY 1, 2, 3),
ranked AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS copy FROM content),
gone AS (SELECT DISTINCT l.doc_id, l.no FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.n BETWEEN i AND j WHERE copy > 1)
SELECT s.doc_id, coalesce(string_agg(s.line, chr(10) ORDER BY s.no) FILTER (WHERE g.no IS NULL), '') AS text,
       count(*) FILTER (WHERE trim(s.line, E' 	
') <> '') AS n_lines, count(g.no) AS n_removed
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.no = g.no GROUP BY s.doc_id""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@_register("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_personal_data(table(spark, sf_dir, "documents")))


@_register("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep_text=False)


@_register("op1_near_duplicates", sql=r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
copies AS (SELECT s, min(doc_id) AS copy_id, count(*) AS n_copies FROM sets GROUP BY s),
shingles AS (SELECT copy_id, len(s) AS size, unnest(s) AS shingle FROM copies),
shared AS (SELECT a.copy_id AS a, b.copy_id AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS n
           FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.copy_id <> b.copy_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 5 * n >= 4 * (sa + sb - n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a),
degree AS (SELECT l.a, sum(c.n_copies) AS n FROM links l JOIN copies c ON c.copy_id = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(k.class_id, c.copy_id) AS class_id, c.copy_id, c.n_copies, (coalesce(g.n, 0) + c.n_copies - 1)::BIGINT AS n_links
FROM sets d JOIN copies c ON d.s = c.s LEFT JOIN classes k ON k.a = c.copy_id LEFT JOIN degree g ON g.a = c.copy_id""")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@_register("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def _round_sql(k: int) -> str:
    """Assignment ``near{k}`` of all parts to ``book{k}``, and the book after it."""
    return f"""
near{k} AS (SELECT n, c.p, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b.c[i]) * (x[i] - b.c[i])))::BIGINT, e := b.e)) AS m
           FROM cut c JOIN book{k} b ON b.p = c.p GROUP BY n, c.p),
mean{k} AS (SELECT p, e, list(f ORDER BY i) AS c FROM (
             SELECT a.p, m.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS f
             FROM near{k} a JOIN cut c ON c.n = a.n AND c.p = a.p CROSS JOIN LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY a.p, m.e, i) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} u ON u.p = b.p AND u.e = b.e)"""


@_register("op12_vector_codes", sql=f"""
WITH whole AS (SELECT vec_id, label, embedding FROM embeddings
               WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM whole
         WHERE len(embedding) = (SELECT len(embedding) FROM whole ORDER BY vec_id NULLS LAST, embedding LIMIT 1)),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS n FROM kept),
cut AS (SELECT n, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM numbered, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, n AS e, x AS c FROM cut WHERE n < 64),{_round_sql(0)},{_round_sql(1)},
final AS (SELECT n, c.p, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b.c[i]) * (x[i] - b.c[i])))::BIGINT, e := b.e)) AS m
          FROM cut c JOIN book2 b ON b.p = c.p GROUP BY n, c.p),
coded AS (SELECT n, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM final GROUP BY n),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM numbered JOIN coded USING (n) CROSS JOIN digest""")
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


@_register("op13_prefix_trie", sql=r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS o,
         sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
sized AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
            xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ord((conv_id::VARCHAR)[i])::BIGINT)),
              lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 4 AS h
          FROM own GROUP BY conv_id),
plan AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS taken FROM sized s LEFT JOIN sized b ON b.conv_id = s.base),
built AS (SELECT p.conv_id, o - h + taken AS pos, item, words FROM plan p JOIN own USING (conv_id) WHERE o >= h
          UNION ALL SELECT p.conv_id, o, item, words FROM plan p JOIN own ON own.conv_id = p.base WHERE o < h),
paths AS (SELECT conv_id, pos, words, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM built),
members AS (SELECT conv_id, path, pos + 1 AS depth, words FROM paths UNION ALL SELECT conv_id, '', 0, 0 FROM plan),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM members GROUP BY path, depth),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
base AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
spread AS (SELECT left(path, 64 * k) AS path, n_children, n, words FROM base, LATERAL (SELECT unnest(range(depth + 1)) AS k)),
totals AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * words)::BIGINT AS saved_tokens FROM spread GROUP BY path),
tails AS (SELECT conv_id, max(path) AS path FROM members GROUP BY conv_id),
ends AS (SELECT path, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM tails GROUP BY path)
SELECT b.conv_id, b.depth, u.conv_id AS parent_conv_id, b.n AS n_convs, b.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM base b JOIN totals t USING (path) LEFT JOIN ends e USING (path) LEFT JOIN base u ON b.depth > 0 AND u.path = left(b.path, 64 * (b.depth - 1))""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
