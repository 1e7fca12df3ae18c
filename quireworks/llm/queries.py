"""The queries of the thirteen operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm import anisotropic_ann, bpe_stream, license_templates, line_dedup, outliers, prefix_trie, quality_gam, simhash, source_mix, spelling_variants, token_rollups, url_cascade, winnowing
from quireworks.llm.common import save, shared_dir, table

#: Fixed values of the URL rules and of the published list of unwanted domains.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = [f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.mcd_outliers(table(spark, sf_dir, "documents"))


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    return url_cascade.filter_urls(table(spark, sf_dir, "pages"), listed, URL_RULES)


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, then those with doc_id % 10 = 3 deleted, and those with doc_id % 10 = 7 revised as if their text
    stood twice in them; the second batch is delivered again."""
    docs = table(spark, sf_dir, "documents")
    counts = save(token_rollups.bpe_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), "byte_bpe_50k").unionByName(token_rollups.word_counts(docs)))
    none = F.lit(None).cast("bigint")
    first = counts.withColumns({"op": F.lit("insert"), "old_tokens": none})
    gone = counts.where("doc_id % 10 = 3").withColumns({"op": F.lit("delete"), "old_tokens": F.col("n_tokens"), "n_tokens": none})
    revised = counts.where("doc_id % 10 = 7").withColumns({"op": F.lit("revise"), "old_tokens": F.col("n_tokens"), "n_tokens": 2 * F.col("n_tokens")})
    rollup = token_rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.apply(1, first)
    for _ in range(2):
        rollup.apply(2, gone.unionByName(revised))
    return rollup.totals()


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.array("source").alias("sources"), source_mix.size_of(F.col("text")).alias("size"))
    return source_mix.mix_sizes(save(sized))


def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.label(license_templates.scan(table(spark, sf_dir, "documents")))


def op6_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("tag")


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(save(prefix_trie.sequences(table(spark, sf_dir, "conversations")))))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(spelling_variants.runs(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_outliers, op2_url_cascade, op3_token_rollups, op4_source_mix, op5_license_templates, op6_anisotropic_ann, op7_simhash, op8_line_dedup, op9_bpe_stream, op10_quality_gam, op11_prefix_trie, op12_winnowing, op13_spelling_variants)}


def _url_rule_sql() -> str:
    cases = []
    for rule, _ in sorted(URL_RULES, key=lambda r: -len(r[0])):
        host, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    return "CASE " + " ".join(cases) + " END"


URL_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (SELECT *, {_url_rule_sql()} AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({', '.join(f"'{r}'" for r, v in URL_RULES if v == 'allow')}) THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN {' OR '.join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED_DOMAINS)} THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""

_WORD = r"[^\x20\x09-\x0D。！？；：，、]*[。！？；：，、]+|[^\x20\x09-\x0D。！？；：，、]+"
_CLOSING = r"""["''”’»)\]]?$"""

PASSAGE_SQL = rf"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
cut AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*(?:{_WORD})') AS a FROM texts)),
placed AS (
  SELECT doc_id, k, regexp_replace(x, '^[\x20\x09-\x0D]*', '') AS w, sum(length(x)) OVER o AS finish,
         sum(CASE WHEN contains(x, chr(10)) THEN 1 ELSE 0 END) OVER o AS line
  FROM cut WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
words AS (
  SELECT *, trim(regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS n, finish - length(w) AS start,
         list_sum([unicode(c) FOR c IN string_split(regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]+', '', 'g'), '')]) AS chk
  FROM placed WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]')),
ended AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY k) != line, true) AS line_end FROM words),
marked AS (SELECT *, line_end OR regexp_matches(w, '[.!?;:…。！？；：]{_CLOSING}') AS s_end FROM ended),
in_sentence AS (SELECT *, coalesce(sum(s_end::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM marked),
pieced AS (SELECT *, s_end OR (count(*) OVER (PARTITION BY doc_id, s) > {line_dedup.LONG} AND (regexp_matches(w, '[,，、]{_CLOSING}') OR chk % {line_dedup.WORD_CUT} = 0)) AS p_end FROM in_sentence),
in_piece AS (SELECT *, coalesce(sum(p_end::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM pieced),
united AS (SELECT *, p_end AND (line_end OR count(*) OVER q >= {line_dedup.SHORT} OR sum(chk) OVER q % {line_dedup.PIECE_CUT} = 0) AS u_end FROM in_piece WINDOW q AS (PARTITION BY doc_id, p)),
in_unit AS (SELECT *, coalesce(sum(u_end::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM united),
units AS (SELECT doc_id, u, min(start) AS start, max(finish) AS finish, count(*) AS words, sum(length(replace(n, ' ', ''))) AS chars, string_agg(n, ' ' ORDER BY k) AS n FROM in_unit GROUP BY doc_id, u),
-- a unit has a word at least, so a stretch has at most as many units as words are asked for
runs AS (
  SELECT doc_id, u, start, list(n) OVER f AS ns, list(finish) OVER f AS ends, list(words) OVER f AS ws, list(chars) OVER f AS cs
  FROM units WINDOW f AS (PARTITION BY doc_id ORDER BY u ROWS BETWEEN CURRENT ROW AND {line_dedup.MIN_WORDS - 1} FOLLOWING)),
tried AS (SELECT *, unnest(range(1, len(ns) + 1)) AS m FROM runs),
sized AS (
  SELECT doc_id, u, m, start, ends[m] AS finish, list_sum(ws[1:m]) AS words, list_sum(cs[1:m]) AS chars, ws[1] AS w1, cs[1] AS c1, ws[m] AS wm, cs[m] AS cm, ns FROM tried),
taken AS (
  SELECT doc_id, start, finish, array_to_string(ns[1:m], ' ') AS n FROM sized
  WHERE (words >= {line_dedup.MIN_WORDS} OR chars >= {line_dedup.MIN_CHARS})
    AND (words - wm < {line_dedup.MIN_WORDS} AND chars - cm < {line_dedup.MIN_CHARS} OR words - w1 < {line_dedup.MIN_WORDS} AND chars - c1 < {line_dedup.MIN_CHARS})),
firsts AS (SELECT n, min(struct_pack(d := doc_id, s := start, e := finish)) AS f FROM taken GROUP BY n),
later AS (
  SELECT doc_id, CASE WHEN doc_id = f.d THEN greatest(start, f.e) ELSE start END AS b, finish AS e, f.d AS kept_doc_id, f.s AS kept_start
  FROM taken JOIN firsts USING (n) WHERE doc_id != f.d OR start != f.s),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY b, e, kept_doc_id, kept_start ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY doc_id ORDER BY b, e, kept_doc_id, kept_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh
        FROM later WHERE b < e))
SELECT doc_id, CAST(min(b) AS BIGINT) AS start, CAST(max(e) - min(b) AS BIGINT) AS length,
       arg_min(kept_doc_id, struct_pack(b, e, kept_doc_id, kept_start)) AS kept_doc_id, CAST(arg_min(kept_start, struct_pack(b, e, kept_doc_id, kept_start)) AS BIGINT) AS kept_start
FROM islands GROUP BY doc_id, run
"""



def _crc(of: str) -> str:
    """The checksum CRC-32 of a string, unsigned: its bits, lowest first, are divided out one by one."""
    bits = f"flatten([[((CAST(('0x' || h) AS UBIGINT) >> k) & 1) FOR k IN range(8)] FOR h IN regexp_extract_all(hex({of}), '..')])"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], {bits}), lambda c, b: xor(c >> 1, CAST(3988292384 AS UBIGINT) * (xor(c, b) & 1))), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# a node is told by the digests of its turns in a row, 32 characters a turn, so the nodes above it are its prefixes
TRIE_SQL = rf"""
WITH given AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, CAST({_crc("CAST(conv_id AS VARCHAR)")} % 4 AS INT) AS h FROM (SELECT DISTINCT conv_id FROM given)),
parts AS (
  SELECT c.conv_id, 0 AS part, g.k, g.role, g.text FROM convs c JOIN given g ON g.conv_id = c.conv_id - c.conv_id % 20 WHERE g.k <= c.h
  UNION ALL SELECT c.conv_id, 1, g.k, g.role, g.text FROM convs c JOIN given g ON g.conv_id = c.conv_id WHERE g.k > c.h),
turns AS (
  SELECT conv_id, row_number() OVER o AS d, string_agg(md5(length(role) || ':' || role || ':' || text), '') OVER (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING) AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
  FROM parts WINDOW o AS (PARTITION BY conv_id ORDER BY part, k)),
members AS (SELECT * FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM members GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (
  SELECT left(path, 32 * CAST(u AS INT)) AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * w) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS u FROM own) GROUP BY 1),
ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS e
  FROM members WHERE length(path) = 32 * d AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = members.conv_id AND t.d = members.d + 1) GROUP BY path)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(e, '')) AS ends_sha256
FROM own o JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON o.depth > 0 AND p.path = left(o.path, length(o.path) - 32)
"""

_ITEM_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAK_SQL = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), {winnowing.SPAN}) AS s FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM items)),
docs AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_ITEM_WORDS} END AS w FROM documents),
places AS (SELECT r, s, i, array_to_string(w[i:i + s - 1], ' ') AS x FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM docs, (SELECT DISTINCT s FROM asked))),
hits AS (SELECT r, s, i, x FROM places JOIN (SELECT DISTINCT s, x FROM asked) USING (s, x)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + s)) AS p FROM hits) GROUP BY r),
of_doc AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits JOIN asked USING (s, x)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN of_doc USING (r)
"""

VARIANT_SQL = rf"""
WITH RECURSIVE found AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c FROM found GROUP BY id, run),
summed AS (SELECT *, {_crc("id || ':' || run")} AS h FROM counted),
typed AS (SELECT CASE WHEN h % {spelling_variants.LOSSY} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM summed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= {spelling_variants.MIN_LENGTH} GROUP BY word HAVING sum(c) >= {spelling_variants.MIN_COUNT}),
masked AS (SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other FROM masked x JOIN masked y USING (i, a, b) WHERE x.word != y.word
  UNION SELECT m.word, w.word FROM masked m JOIN words w ON w.word = m.a || m.b
  UNION SELECT w.word, m.word FROM masked m JOIN words w ON w.word = m.a || m.b),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, struct_pack(m := -n, w := other)) AS other, max(n) AS m FROM near JOIN words ON words.word = other GROUP BY near.word),
formed AS (SELECT word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS reached, form AS next FROM formed UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT word, form, reached AS root, n, n_near, form_n FROM formed JOIN (SELECT word, reached FROM chain WHERE next IS NULL) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_cascade": URL_SQL, "op8_line_dedup": PASSAGE_SQL, "op11_prefix_trie": TRIE_SQL, "op12_winnowing": LEAK_SQL, "op13_spelling_variants": VARIANT_SQL}
