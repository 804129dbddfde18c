"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, licenses, line_dedup, mixing, quality_gam, quality_rules, sharding, simhash, substring_dedup, toxicity
from .common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


#: Words, windows and hashes of the windows that start in an earlier document.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
seq AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM win),
late AS (SELECT r, i FROM seq JOIN (SELECT s, min(doc_id) AS m FROM seq GROUP BY s) USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, i + unnest(range(50)) AS p FROM late),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM
  (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Lines with a word, less white space at their ends; a line goes if it is part of a pair of lines, or is a line of 20 words, that an earlier document has.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
l AS (SELECT r, doc_id, raw, p, row_number() OVER (PARTITION BY r ORDER BY p) AS i, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
      FROM a WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
k AS (SELECT r, doc_id, i, 2 AS n, s || chr(10) || lead(s) OVER (PARTITION BY r ORDER BY i) AS k FROM l
      UNION ALL SELECT r, doc_id, i, 1, s FROM l WHERE len(regexp_split_to_array(s, '[\x20\x09-\x0D]+')) >= 20),
g AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS i FROM k JOIN (SELECT n, k, min(doc_id) AS m FROM k GROUP BY ALL) USING (n, k) WHERE m < doc_id),
x AS (SELECT l.r, p FROM l JOIN g USING (r, i)),
kept AS (SELECT a.r, string_agg(raw, chr(10) ORDER BY p) AS kept FROM a ANTI JOIN x USING (r, p) GROUP BY a.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM l GROUP BY r) USING (r) LEFT JOIN (SELECT r, count(*) AS m FROM x GROUP BY r) USING (r)
"""

OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
seq AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM win),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM seq JOIN (SELECT r, s FROM seq GROUP BY r, s HAVING count(*) > 1) USING (r, s), range(5) x(k) GROUP BY r),
f AS (SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (r)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
rules(rule, j, sign, cutoff) AS (VALUES {rules}),
rr AS (SELECT g.*, rule, j, CASE rule WHEN 'symbols' THEN CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END
    WHEN 'dup_lines' THEN CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END WHEN 'repeats' THEN CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END
    ELSE CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END END * sign > cutoff * sign AS fails FROM g, rules),
l AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT lang AS stratum, rule, j, count(*) FILTER (WHERE good AND fails) AS k, count(*) FILTER (WHERE NOT good AND fails) AS bad
    FROM rr JOIN l USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL GROUP BY ALL),
path AS (SELECT rule, j, row_number() OVER (ORDER BY list_position([{names}], rule), j) AS step FROM rules),
f1 AS (SELECT r, lang AS stratum, good, min(step) FILTER (WHERE fails) AS first FROM rr JOIN l USING (doc_id) JOIN path USING (rule, j) WHERE NOT base_failed AND lang IS NOT NULL GROUP BY ALL),
p AS (SELECT stratum, step, n, k, CASE WHEN k >= n * {p} THEN 0.0 ELSE (SELECT ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) FROM range(k + 1) y(i)) END AS tail
    FROM (SELECT stratum, step, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND first <= step) AS k FROM f1, path GROUP BY ALL)),
q AS (SELECT stratum, step, bool_and(n > 0 AND tail <= ln({delta} * greatest(n, 1) / (SELECT count(*) FILTER (WHERE good) FROM f1))) OVER (PARTITION BY stratum ORDER BY step) AS certified FROM p),
u AS (SELECT stratum, rule, arg_max(j, (bad - {cost} * k, -j)) AS j FROM c JOIN path USING (rule, j) JOIN q USING (stratum, step) WHERE certified AND bad - {cost} * k > 0 GROUP BY ALL),
x AS (SELECT rr.r, string_agg(rr.rule, ',' ORDER BY list_position([{names}], rr.rule)) AS failed_rules FROM rr JOIN u ON u.stratum = rr.lang AND u.rule = rr.rule AND u.j = rr.j WHERE fails GROUP BY rr.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules IS NULL AS kept, lang, coalesce(failed_rules, '') AS failed_rules
FROM g LEFT JOIN x USING (r)
"""


def _op3_sql() -> str:
    risk, rules = quality_rules.Risk(), quality_rules.RULES
    rows = ", ".join(f"('{r}', {j}, {sign}, {c})" for r, (_, sign, cutoffs) in rules.items() for j, c in enumerate(cutoffs, 1))
    return OP3_SQL.format(rules=rows, p=risk.limit, delta=risk.delta, cost=risk.cost, names=", ".join(f"'{r}'" for r in rules))


OP8_SQL = """
WITH RECURSIVE tree(n, node, child, w) AS (VALUES
{tree}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents),
s1 AS (SELECT n, r, arg_min(child, -ln((('0x' || substr(md5(k || '/' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496) / w) AS c
       FROM d, tree WHERE node = '' GROUP BY n, r),
s2 AS (SELECT s1.n, s1.r, arg_min(child, -ln((('0x' || substr(md5(k || '/' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496) / w) AS c
       FROM s1 JOIN d USING (r) JOIN tree ON tree.n = s1.n AND node = s1.c GROUP BY s1.n, s1.r),
s3 AS (SELECT s2.n, s2.r, arg_min(child, -ln((('0x' || substr(md5(k || '/' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496) / w) AS c
       FROM s2 JOIN d USING (r) JOIN tree ON tree.n = s2.n AND node = s2.c GROUP BY s2.n, s2.r),
p AS (SELECT d.*, s1.c AS region, s2.c AS rack, s3.c::INT AS shard, g.c::INT AS grown_shard, strlen(t) + 1 AS size,
             ('0x' || substr(md5('slot/' || k), 1, 13))::BIGINT % greatest(256, ceil((SELECT count(*) FROM documents) / 50000))::BIGINT AS bucket
      FROM d JOIN s1 ON s1.r = d.r AND s1.n = 16 JOIN s2 ON s2.r = d.r AND s2.n = 16
             JOIN s3 ON s3.r = d.r AND s3.n = 16 JOIN s3 g ON g.r = d.r AND g.n = 17),
crcs AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i))),
q AS (SELECT p.*, CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)),
        lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295::BIGINT) END AS text_crc32 FROM p, crcs)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, grown_shard, region, rack,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS LAST, text_crc32, size) - 1 AS slot
FROM q
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size, md5(coalesce(text, '')) AS th FROM documents),
n AS (SELECT sum(size)::BIGINT AS total, least(greatest(sum(size) // {slots}, {low}), {high})::BIGINT AS block, greatest(256, ceil(count(*) / 50000))::BIGINT AS buckets FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][no % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM s0),
s2 AS (SELECT *, sum(most) OVER (ORDER BY most / w, no) AS full_here, sum(w) OVER () - sum(w) OVER (ORDER BY most / w, no) AS rest FROM s1),
s3 AS (SELECT s2.*, full_here + most / w * rest <= total AS capped, total FROM s2, n),
s4 AS (SELECT *, CASE WHEN capped THEN most ELSE w * (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN no = max(no) OVER () THEN 1.0 ELSE sum(target) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING) / CASE WHEN total > 0 THEN total ELSE 1 END END AS hi FROM s4),
s6 AS (SELECT s5.*, coalesce(lag(hi) OVER (ORDER BY no), 0.0) AS lo,
  CASE WHEN block > {low} AND least(source_size, target) < {few} * block THEN greatest(floor(least(source_size, target) / {few}), 1) ELSE block END::BIGINT AS step FROM s5, n),
sl AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(ceil(total / block)::BIGINT)) AS i FROM n)),
dr AS (SELECT no, source_size, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS rk FROM sl JOIN s6 ON u >= lo AND u < hi, n WHERE step = block),
ow AS (SELECT no, source_size, step, target, least(floor(target / source_size), 3) AS times_whole, ceil(source_size / step) AS blocks FROM s6, n WHERE step < block AND source_size > 0),
ox AS (SELECT no, blocks, least(times_whole * blocks + round((target - times_whole * source_size) / step), blocks * 3)::BIGINT AS n_own FROM ow),
bl AS (SELECT no, rk % ceil(source_size / block)::BIGINT AS b, count(*) AS times FROM dr, n WHERE rk // ceil(source_size / block)::BIGINT < 3 GROUP BY ALL
  UNION ALL SELECT no, rk % blocks::BIGINT, count(*) FROM (SELECT no, blocks, unnest(range(n_own)) AS rk FROM ox) GROUP BY ALL),
o AS (SELECT d.*, no, source_size, target, step, ('0x' || substr(md5('0/' || coalesce(doc_id::VARCHAR, '') || '/' || th), 1, 13))::BIGINT AS draw FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
st AS (SELECT o.*, row_number() OVER () AS r, sum(size) OVER (PARTITION BY no ORDER BY draw % buckets, draw, doc_id NULLS LAST, th, size ROWS UNBOUNDED PRECEDING) - size AS start FROM o, n),
fr AS (SELECT st.r, no, unnest(range((start // step)::BIGINT, ((start + size - 1) // step)::BIGINT + 1)) AS b, start, size, step FROM st WHERE size > 0),
tk AS (SELECT r, sum((least(start + size, (b + 1) * step) - greatest(start, b * step)) * times)::BIGINT AS taken FROM fr JOIN bl USING (no, b) GROUP BY r)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken FROM st LEFT JOIN tk USING (r)
"""

TREE = sharding.Tree.regular(2, 2, 4)


def op9_sql() -> str:
    low, high = mixing.BLOCK_RANGE
    return OP9_SQL.format(slots=mixing.SLOTS, low=low, high=high, few=mixing.FEW)


def _tree_rows() -> str:
    rows = [(n, node, child, w) for n, tree in ((16, TREE), (17, TREE.grown())) for level in tree.levels() for node, below in level.items() for child, w in below.items()]
    return ",\n".join(f"({n}, '{node}', '{child}', {w})" for n, node, child, w in rows)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels, "toxic", ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op8_sharding", OP8_SQL.format(tree=_tree_rows()))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return sharding.shard(docs, TREE, TREE.grown()).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )


@query("op9_mixing", op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents"))).drop("text_hash").withColumn("target", F.round("target", 6))


@query("op3_quality_rules", _op3_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_rules.apply_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", F.array_join("failed_rules", ",").alias("failed_rules")
    )


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_substring_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_quality_gam")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    gam = quality_gam.train(docs, labels, "quality", ~held_out)
    return quality_gam.score(docs, gam).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op1_licenses")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(docs))
    sure = F.filter("hits", lambda h: h["confirmed"])
    first = F.get(F.array_sort(F.transform(sure, lambda h: F.struct((-h["probability"]).alias("p"), h["family"].alias("family"), h["similarity"].alias("similarity")))), 0)
    return found.select(
        "doc_id", "n_paragraphs", first["family"].alias("license"), (-first["p"]).alias("probability"), first["similarity"].alias("similarity"),
        F.size(sure).alias("n_confirmed"), (F.size("hits") - F.size(sure)).alias("n_unconfirmed"),
    )
