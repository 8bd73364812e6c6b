"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.session import shared_folder

from .brown import score_texts
from .common import table
from .decontamination import find_hits
from .divergence import audit
from .language_id import identify
from .licenses import find_licenses
from .mixing import mix
from .ngram_join import near_duplicates
from .quality_rules import judge
from .resampling import resample
from .secrets import find_secrets
from .spelling_variants import group_variants
from .substring_dedup import remove_repeated
from .warc import read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query(
    "op5_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM s),
    m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
    r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM g JOIN m USING (k) WHERE doc_id > first),
    p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
    k AS (SELECT p.doc_id, p.i, p.word, r.p IS NOT NULL AS gone FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.p = p.i),
    a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
    FROM d LEFT JOIN a USING (doc_id)
    """,
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"), keep_text=False)


@query(
    "op2_mixing",
    r"""
    WITH n AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS name FROM documents),
    m AS (SELECT *, name || '|' || row_number() OVER (PARTITION BY source, name) AS name_no FROM n),
    d AS (SELECT doc_id, source, size, ('0x' || substr(md5('mix|' || name_no), 1, 13))::BIGINT % 1024 AS block, ('0x' || substr(md5('mix|doc|' || name_no), 1, 13))::BIGINT AS k FROM m),
    b AS (SELECT source, block, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
    s AS (SELECT source, sum(words)::BIGINT AS source_size FROM b GROUP BY source),
    p AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s),
    w AS (SELECT *, [1, 2, 3][(place - 1) % 3 + 1]::BIGINT AS weight, source_size * 3 AS bound FROM p),
    o AS (SELECT *, coalesce(sum(bound) OVER t, 0)::BIGINT AS spent, (sum(weight) OVER () - coalesce(sum(weight) OVER t, 0))::BIGINT AS open, (sum(source_size) OVER ())::BIGINT AS total
      FROM w WINDOW t AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT (total - spent)::DOUBLE / open AS factor FROM o WHERE bound >= (total - spent)::DOUBLE / open * weight ORDER BY spent, factor LIMIT 1),
    g AS (SELECT source, source_size, place, least(bound::DOUBLE, factor * weight) AS target FROM o, f),
    n AS (SELECT g.*, b.block, b.words, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
    f0 AS (SELECT *, ('0x' || substr(md5('mix|' || place || '|' || passes || '|' || block), 1, 13))::BIGINT AS k, target - passes * source_size AS room, false AS whole FROM n),
    """
    + "".join(
        f"""
    a{i} AS (SELECT *, NOT whole AND words <= room AS fits FROM f{i - 1}),
    b{i} AS (SELECT *, fits AND (sum(CASE WHEN fits THEN words END) OVER (PARTITION BY place ORDER BY k, block))::BIGINT <= room AS now FROM a{i}),
    f{i} AS (SELECT * EXCLUDE (fits, now, room, whole), room - coalesce(sum(CASE WHEN now THEN words END) OVER (PARTITION BY place), 0)::BIGINT AS room, whole OR coalesce(now, false) AS whole FROM b{i}),"""
        for i in range(1, 5)
    )
    + r"""
    r AS (SELECT *, NOT whole AND room > 0 AND row_number() OVER (PARTITION BY place ORDER BY whole, words, k, block) = 1 AS some FROM f4),
    x AS (SELECT r.place, d.block, d.k, r.room, sum(d.size)::BIGINT AS words FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block WHERE r.some GROUP BY ALL),
    y AS (SELECT *, (sum(words) OVER (PARTITION BY place, block ORDER BY k))::BIGINT - words AS before FROM x),
    c AS (SELECT place, block, max(k) AS cut FROM y WHERE before + words / 2 <= room GROUP BY ALL)
    SELECT d.doc_id, d.size, r.source_size, r.target,
      (d.size * (r.passes + CASE WHEN r.whole OR (r.some AND coalesce(d.k <= c.cut, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block LEFT JOIN c ON c.place = r.place AND c.block = r.block
    """,
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op3_decontamination",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    l AS (SELECT item_id, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0),
    t AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS s FROM l)),
    r AS (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM t) WHERE len(w) >= m)),
    h AS (SELECT doc_id, s, r.m, item_id FROM r JOIN t ON r.k = t.k AND r.m = t.m),
    p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM h) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


@query(
    "op4_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
    m AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
    e AS (SELECT page_id, body, h, first, [('0x' || substr(h, 1 + 5 * i, 5))::INT FOR i IN range(8)] AS v FROM p JOIN m USING (h))
    SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 15) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 10) & 31), 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 5) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x & 31), 1) FOR x IN v], '') AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
    FROM e
    """,
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "op4-archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(F.col("page_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint"))


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_importance_resampling")
def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", F.col("sampled").alias("kept"))


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("families", ",").alias("families"), "n_unknown", F.size("licenses").cast("bigint").alias("n_licenses"))


@query(
    "op11_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS m FROM o GROUP BY ALL),
    l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(m) >= 30),
    k AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT lang, source, sum(c.n) AS total FROM c JOIN l USING (lang, term) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * k.v) AS p, 1 + (1000000000::HUGEINT * (l.n + 5)) // (k.total + 5 * k.v) AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
    x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    z AS (SELECT * FROM y UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
    r AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM z)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """,
)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


@query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE t AS (
      SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
    r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
    g AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r WHERE length(run) >= 7 GROUP BY ALL),
    h AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(len(x) // 2)], lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM g, t),
    w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    v AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS m FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    k AS (SELECT word, n, m, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM v)),
    e AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM k a JOIN v b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM k a JOIN v b ON a.rest = b.word),
    f AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM e GROUP BY word),
    s AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
    c AS (SELECT word, form AS at FROM s WHERE form IS NOT NULL UNION SELECT c.word, s.form FROM c JOIN s ON c.at = s.word WHERE s.form IS NOT NULL),
    z AS (SELECT c.word, c.at FROM c JOIN s ON c.at = s.word WHERE s.form IS NULL)
    SELECT s.word, s.n, s.n_near, s.form, s.form_n, coalesce(z.at, s.word) AS root FROM s LEFT JOIN z USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


@query("op13_class_model")
def op13_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
