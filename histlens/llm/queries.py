"""The registered queries of the training-data operators, and their DuckDB forms where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .band_join import band_join
from .common import documents
from .exact_dedup import exact_dedup
from .huffman import read_tokens, write_tokens
from .language_id import fit, identify, is_held_out
from .license_scan import DENOMINATOR, NOT_WORD, NUMERATOR, PHRASES, SPREAD, TEMPLATES, license_scan, required_runs
from .line_dedup import line_dedup
from .mixing import mixed
from .packing import packed
from .pii import personal_data
from .quality import quality_rules
from .resampling import resample
from .sharding import balanced
from .simhash_dedup import near_duplicates
from .tokens import tokenizer_path

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5_SQL = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
win AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL) x WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) x GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM ln WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM m),
u AS (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats FROM v WHERE NOT base_failed) ON word_length, symbols, dup_lines, repeats INTO NAME measure VALUE x),
leaf AS (SELECT lang, source, measure, CASE measure WHEN 'symbols' THEN 950 ELSE 990 END AS share, x - x % (1 << greatest(length(bin(x)) - 6, 0)) AS b FROM u),
ranked AS (
  SELECT 'own' AS level, lang, source, measure, share, b, row_number() OVER (PARTITION BY lang, source, measure ORDER BY b) AS r, count(*) OVER (PARTITION BY lang, source, measure) AS n FROM leaf
  UNION ALL SELECT 'language', lang, NULL, measure, share, b, row_number() OVER (PARTITION BY lang, measure ORDER BY b), count(*) OVER (PARTITION BY lang, measure) FROM leaf
  UNION ALL SELECT 'every', NULL, NULL, measure, share, b, row_number() OVER (PARTITION BY measure ORDER BY b), count(*) OVER (PARTITION BY measure) FROM leaf),
q0 AS (SELECT level, lang, source, measure, any_value(n) AS n, min(b) FILTER (4 * r >= n) AS q1, min(b) FILTER (2 * r >= n) AS q2, min(b) FILTER (4 * r >= 3 * n) AS q3,
    min(b) FILTER (1000 * r >= share * n) AS t, min(b) FILTER (1000 * r >= 990 * n) AS furthest FROM ranked GROUP BY level, lang, source, measure),
q AS (SELECT *, CASE WHEN t > q2 THEN t ELSE furthest END AS tail FROM q0),
h AS (SELECT *, 2 * (tail + (1 << greatest(length(bin(tail)) - 6, 0)) - 1) - q2 AS beyond FROM q WHERE q3 > q1 OR tail > q2 OR level = 'every'),
f AS (SELECT level, lang, source, measure, n, CASE WHEN q3 = q1 THEN beyond WHEN measure = 'word_length' THEN 4 * q3 - 3 * q1 + 1000 ELSE greatest(4 * q3 - 3 * q1, beyond) END AS high,
    CASE WHEN q3 > q1 AND measure = 'word_length' THEN 4 * q1 - 3 * q3 - 1000 END AS low FROM h),
g AS (SELECT d.lang, d.source, m.measure, CASE WHEN o.n >= 100 THEN {{'high': o.high, 'low': o.low}} WHEN l.n >= 100 THEN {{'high': l.high, 'low': l.low}} ELSE {{'high': e.high, 'low': e.low}} END AS z
  FROM (SELECT DISTINCT lang, source FROM v) d CROSS JOIN (SELECT DISTINCT measure FROM f) m
  LEFT JOIN (SELECT * FROM f WHERE level = 'own') o ON d.lang IS NOT DISTINCT FROM o.lang AND d.source IS NOT DISTINCT FROM o.source AND m.measure = o.measure
  LEFT JOIN (SELECT * FROM f WHERE level = 'language') l ON d.lang IS NOT DISTINCT FROM l.lang AND m.measure = l.measure LEFT JOIN (SELECT * FROM f WHERE level = 'every') e ON m.measure = e.measure),
c AS (SELECT lang, source, max(z.high) FILTER (measure = 'word_length') AS wh, max(z.low) AS wl, max(z.high) FILTER (measure = 'symbols') AS sh, max(z.high) FILTER (measure = 'dup_lines') AS dh,
    max(z.high) FILTER (measure = 'repeats') AS rh FROM g GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_length <= wh, true) AND coalesce(word_length >= wl, true) AND coalesce(symbols <= sh, true) AND coalesce(dup_lines <= dh, true) AND coalesce(repeats <= rh, true) AS kept
FROM v LEFT JOIN c ON v.lang IS NOT DISTINCT FROM c.lang AND v.source IS NOT DISTINCT FROM c.source
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s),
v AS (SELECT *, [5, 2, 1][(k + 1)::INT]::BIGINT AS weight, [-0.5, 0, 0.5][(k + 1)::INT]::DOUBLE AS slope FROM w),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 10 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
    sum(weight) OVER (ORDER BY source_size * 10 // weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights FROM v),
h AS (SELECT *, (total - spent) * weight > 3 * source_size * weights AS held FROM o),
r AS (SELECT *, total - coalesce(sum(3 * source_size) FILTER (held) OVER (), 0)::BIGINT AS rest, (sum(weight) FILTER (NOT held) OVER ())::BIGINT AS open FROM h),
t AS (SELECT source, source_size, slope, total, CASE WHEN held THEN (3 * source_size)::DOUBLE ELSE (rest * weight)::DOUBLE / open::DOUBLE END AS target FROM r),
c AS (SELECT doc_id, source, size, 2 * coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size AS middle FROM d),
m AS (SELECT doc_id, size, source_size, target, slope, total, list_filter([middle, middle + 2 * source_size, middle + 4 * source_size], lambda x: x < 2 * target) AS ms
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, ms[1]::DOUBLE / (2 * target) AS u, ms[-1]::DOUBLE / (2 * target) AS z FROM m)
SELECT doc_id, size, source_size, target, size * len(ms) AS taken,
  CASE WHEN len(ms) > 0 THEN floor(2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) * total::DOUBLE)::BIGINT END AS first_position,
  CASE WHEN len(ms) > 0 THEN floor(2 * z / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * z)) * total::DOUBLE)::BIGINT END AS last_position
FROM e
"""


_TEMPLATES = ", ".join(f"('{label}', list_distinct({text.split()}), {required_runs(required)}, '{required.replace("+", " ").split()[0]}', {without.split()}::VARCHAR[], {SPREAD * len(text.split())})" for label, text, required, without in TEMPLATES)
_PHRASES = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in PHRASES.items())
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LICENSE_WORD = "[^" + NOT_WORD[1:]

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_ASCII}) AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_LICENSE_WORD}') AS ws FROM d),
tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM w),
win AS (SELECT doc_id, i, w AS a, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS three,
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS four FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, label FROM win, (VALUES {_PHRASES}) x(phrase, label, n) WHERE phrase = CASE n WHEN 3 THEN three ELSE four END),
base AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, list(DISTINCT label) AS ls FROM p GROUP BY doc_id),
x(label, tw, must, first, without, span) AS (VALUES {_TEMPLATES}),
near AS (SELECT tok.doc_id, x.*, unnest(range(i - span + 1, i + 1)) AS s FROM tok JOIN x ON tok.w = x.first),
seen AS (SELECT near.*, ws[greatest(s, 0) + 1 : s + span] AS b FROM near JOIN w ON near.doc_id = w.doc_id),
spelt AS (SELECT *, ' ' || array_to_string(b, ' ') || ' ' AS spelt FROM seen),
found AS (SELECT *, list_transform(must, lambda y: CASE WHEN regexp_matches(spelt, y) THEN 1 + length(regexp_extract(spelt, '^(.*?)' || y, 1)) ELSE 0 END) AS places FROM spelt),
m AS (SELECT doc_id, label, len(list_intersect(tw, b))::DOUBLE / len(tw) AS s FROM found
  WHERE {DENOMINATOR} * len(list_intersect(tw, b)) >= {NUMERATOR} * len(tw) AND list_min(places) > 0 AND places = list_sort(places) AND len(list_intersect(without, b)) = 0),
f AS (SELECT doc_id, list(DISTINCT label) AS ls, max(s) AS s FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.f::BIGINT AS first_word, base.l::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(f.ls, [])))), ','), '') AS labels, coalesce(f.s, 0) AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN f ON f.doc_id = w.doc_id
"""


def _crc_table() -> list[int]:
    """What each four bits add to a CRC-32."""
    table = list(range(16))
    for _ in range(4):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _crc_sql(digits: str) -> str:
    """DuckDB's CRC-32 of UTF-8 text given as the list of its hexadecimal digits; the low one of a byte counts first."""
    table = ", ".join(f"{c}::BIGINT" for c in _crc_table())
    values = f"list_transform({digits}, lambda x, i: (strpos('0123456789ABCDEF', {digits}[i + 2 * (i % 2) - 1]) - 1)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, x: xor(c >> 4, ([{table}])[(xor(c, x) & 15) + 1])), 4294967295::BIGINT)"


OP11_SQL = f"""
WITH l AS (SELECT sale_id, line_no::BIGINT AS line_no, item_id, floor(100 * amount + 0.5)::BIGINT AS a, quantity::BIGINT AS q FROM sale_lines
  WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND abs(100 * amount + 0.5) < 9e15),
f AS (SELECT *, CASE WHEN q < 0 THEN -(2 * a + q) ELSE 2 * a + q END AS x, 2 * abs(q) AS y,
    string_split(hex(concat(sale_id, ',', line_no, ',', item_id)), '') AS digits FROM l),
s AS (SELECT sale_id, line_no, item_id, (x - (x % y + y) % y) // y AS u, {_crc_sql("digits")} AS crc FROM f),
i AS (SELECT row_number() OVER () AS k, item_id, CASE WHEN abs(100 * price + 0.5) < 9e15 AND item_id IS NOT NULL THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items),
o AS (SELECT item_id, u, count(*) AS n, sum(crc) AS crc FROM s GROUP BY ALL),
g AS (SELECT u, sum(n) AS n, sum(crc) AS crc FROM o GROUP BY u),
t AS (SELECT p, sum(n) AS n, sum(n * abs(u - p)) AS gap_sum, sum(crc) AS crc FROM (SELECT DISTINCT p FROM i) x JOIN g
  ON u BETWEEN p - 100 - abs(p) // 500 AND p + 100 + abs(p) // 500 WHERE abs(u - p) <= 100 OR 1000 * abs(u - p) <= greatest(u, p) GROUP BY p),
m AS (SELECT k, sum(n) AS n, sum(n * abs(u - p)) AS gap_sum, sum(crc) AS crc FROM i JOIN o USING (item_id) WHERE abs(u - p) <= 100 OR 1000 * abs(u - p) <= greatest(u, p) GROUP BY k),
h AS (SELECT sale_id, line_no, item_id AS line_item_id, u FROM s QUALIFY row_number() OVER (PARTITION BY u, item_id ORDER BY sale_id, line_no NULLS FIRST) <= 2),
r AS (SELECT k, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, (row_number() OVER (PARTITION BY k ORDER BY abs(u - p), u, sale_id, line_no NULLS FIRST, line_item_id))::INT AS rank
  FROM i JOIN h ON u BETWEEN p - 100 - abs(p) // 500 AND p + 100 + abs(p) // 500 WHERE (abs(u - p) <= 100 OR 1000 * abs(u - p) <= greatest(u, p)) AND line_item_id <> item_id QUALIFY rank <= 2)
SELECT item_id, coalesce(rank, 0) AS rank, gap, u, sale_id, line_no, line_item_id, (coalesce(t.n, 0) - coalesce(m.n, 0))::BIGINT AS n_pairs,
  (coalesce(t.gap_sum, 0) - coalesce(m.gap_sum, 0))::BIGINT AS gap_sum, (coalesce(t.crc, 0) - coalesce(m.crc, 0))::BIGINT AS lines_crc
FROM i LEFT JOIN t ON t.p = i.p LEFT JOIN m ON m.k = i.k LEFT JOIN r ON r.k = i.k
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '{_LICENSE_WORD}') AS ws FROM documents),
f AS (SELECT k, unnest(ws) AS w FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '{_LICENSE_WORD}')) AS w FROM benchmark),
x AS (SELECT w, string_split(hex(w), '') AS digits FROM (SELECT w FROM f UNION SELECT w FROM b) y),
c AS (SELECT w, {_crc_sql("digits")} % 10000 AS bucket FROM x),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT k, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN c USING (w) JOIN g USING (bucket) GROUP BY k),
v AS (SELECT k, doc_id, len(ws)::BIGINT AS n_features, coalesce((total - (total % n + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (k)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM v),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (k)
"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) + 16 AS size, string_split(hex(coalesce(text, '')), '') AS digits FROM documents),
g AS (SELECT doc_id, t, digest, size, digits, min(doc_id) OVER (PARTITION BY t) AS first, sum(size) OVER (PARTITION BY t) AS together FROM d),
p AS (SELECT *, sum(size) OVER (ORDER BY first NULLS FIRST, digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS whole FROM g),
s AS (SELECT *, CASE WHEN together * 40 <= whole THEN 2 * min(start) OVER (PARTITION BY t) + together ELSE 2 * start + size END AS twice FROM p),
n AS (SELECT *, least(twice * 40 // (2 * whole), 39)::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, {_crc_sql("digits")} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INT AS grown_shard FROM n
"""


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("fp")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~is_held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "spans")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end=1)
    return read_tokens(spark, path, digest=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = F.col("positions")
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.get(positions, F.lit(0)).alias("first_position"), F.when(F.size(positions) > 0, F.element_at(positions, -1)).alias("last_position"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end=0, capacity=2048)


def op11_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return band_join(read("sale_lines"), read("items"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = balanced(documents(spark, sf_dir), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = (op1_simhash_dedup, op2_language_id, op3_token_files, op4_pii, op5_exact_dedup, op6_quality_rules, op7_line_dedup, op8_license_scan, op9_mixing, op10_packing, op11_band_join, op12_resampling, op13_sharding)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_quality_rules": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_license_scan": OP8_SQL, "op9_mixing": OP9_SQL, "op11_band_join": OP11_SQL, "op12_resampling": OP12_SQL, "op13_sharding": OP13_SQL}
