"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, object] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op3_bpe_round_trip")
def _(spark, sf_dir):
    import public_tokenizers

    from skyledger.llm import bpe

    return bpe.round_trip(table(spark, sf_dir), bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json")))


OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
w AS (SELECT *, 3e0 * source_size AS lim, 3e0 * source_size / weight AS fill FROM (
  SELECT source, source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source))),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS MATERIALIZED (SELECT source, source_size, least(lim, weight * (SELECT arg_min(level, fill) FROM lev WHERE level <= fill)) AS target FROM lev),
h AS MATERIALIZED (SELECT d.source, d.size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT t.*, sum(h.size * n)::DOUBLE / sum(n)::DOUBLE AS mean, ln(3e0) * (sum(h.size * n)::DOUBLE / sum(n)::DOUBLE) / min(h.size) + 1e-6 AS top
  FROM t JOIN h ON h.source IS NOT DISTINCT FROM t.source WHERE target < 3 * source_size GROUP BY ALL),
it(step, source, lo, hi) AS (SELECT 0, source, -1e4, top FROM m UNION ALL
  SELECT it.step + 1, it.source, CASE WHEN sum(h.size * h.n * least(3e0, exp(least((lo + hi) / 2 * h.size / m.mean, 50e0)))) < any_value(m.target) THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN sum(h.size * h.n * least(3e0, exp(least((lo + hi) / 2 * h.size / m.mean, 50e0)))) < any_value(m.target) THEN hi ELSE (lo + hi) / 2 END
  FROM it JOIN m ON m.source IS NOT DISTINCT FROM it.source JOIN h ON h.source IS NOT DISTINCT FROM it.source WHERE it.step < 70 GROUP BY it.step, it.source, it.lo, it.hi),
s AS (SELECT t.source, t.source_size, t.target, m.mean, round((it.lo + it.hi) / 2, 6) AS t FROM t LEFT JOIN m ON m.source IS NOT DISTINCT FROM t.source LEFT JOIN it ON it.source IS NOT DISTINCT FROM t.source AND it.step = 70),
r AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, CASE WHEN d.size = 0 THEN 0e0 WHEN s.t IS NULL THEN 3e0 ELSE least(3e0, exp(least(s.t * (d.size::DOUBLE / s.mean), 50e0))) END AS rate
  FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
x AS (SELECT *, floor(rate)::BIGINT AS whole, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296e0 - (rate - floor(rate)) AS excess FROM r),
y AS (SELECT *, CASE WHEN whole < 3 THEN size ELSE 0 END AS room FROM x),
z AS (SELECT *, sum(room) OVER (PARTITION BY source ORDER BY excess, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto, sum(whole * size) OVER (PARTITION BY source) AS sure FROM y)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(room, round(target)::BIGINT - sure - (upto - room))))::BIGINT AS taken FROM z
"""


@register("op6_entropy_mixing", OP6_SQL)
def _(spark, sf_dir):
    from skyledger.llm import mixing

    return mixing.balance(table(spark, sf_dir))


@register("op7_slot_sharding")
def _(spark, sf_dir):
    from skyledger.llm import sharding

    placed = sharding.shard(table(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


@register("op10_language_id")
def _(spark, sf_dir):
    from skyledger.llm import langid

    docs = table(spark, sf_dir).withColumn("held_out", langid.held_out())
    return langid.predict(docs, langid.fit(docs.filter("NOT held_out")), keep=("doc_id", "held_out"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT DISTINCT text, words, unnest(range(0, len(words) - 7)) AS i FROM b WHERE len(words) >= 8),
wk AS (SELECT text, i, array_to_string(words[i + 1:i + 8], ' ') AS w FROM win),
rep AS (SELECT text, i FROM (SELECT text, i, count(*) OVER (PARTITION BY text, w) AS n FROM wk) WHERE n >= 2),
cov AS (SELECT text, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT text, i, lead(i) OVER (PARTITION BY text ORDER BY i) AS nxt FROM rep) GROUP BY text),
tl AS (SELECT DISTINCT source, text, lines FROM b),
ln AS (SELECT source, text, translate(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))), '123456789', '000000000') AS line,
        len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT source, text, unnest(lines) AS l FROM tl)),
copies AS (SELECT source, text, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS n_docs FROM b GROUP BY source, text),
f AS (SELECT source, line FROM (SELECT DISTINCT ln.source, ln.text, line, n_docs FROM ln JOIN copies c ON c.text = ln.text AND c.source IS NOT DISTINCT FROM ln.source) o GROUP BY source, line
      HAVING sum(n_docs) > least(100, greatest(20, 0.1 * (SELECT count(DISTINCT (doc_id, text)) FROM documents x WHERE x.text IS NOT NULL AND x.source IS NOT DISTINCT FROM o.source)))),
lost AS (SELECT ln.source, ln.text, sum(n) AS n FROM ln JOIN f ON ln.source IS NOT DISTINCT FROM f.source AND ln.line = f.line GROUP BY ln.source, ln.text),
r AS (SELECT b.doc_id, len(words) AS n_words, length(regexp_replace(b.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(b.text) - length(translate(b.text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_line_words
      FROM b LEFT JOIN cov ON b.text = cov.text LEFT JOIN lost ON b.text = lost.text AND b.source IS NOT DISTINCT FROM lost.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_line_words::BIGINT AS n_line_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_line_words >= 0.3 * n_words AS kept FROM r
"""


@register("op8_line_frequency", OP8_SQL)
def _(spark, sf_dir):
    from skyledger.llm import line_rules

    return line_rules.rules(table(spark, sf_dir))


@register("op9_secret_forest")
def _(spark, sf_dir):
    from skyledger.llm import secrets

    return secrets.scan(table(spark, sf_dir)).filter("is_secret").select("doc_id", "place", "offset", "candidate", "word", "before", "after", "rule_label", "score", "is_secret")


@register("op5_quality_classifier")
def _(spark, sf_dir):
    from skyledger.llm import quality

    docs = table(spark, sf_dir).select("doc_id", "text", "lang", "source")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p_content", "p_meta", "score")), "kept")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i + 1:i + 20], ' ')) AS k FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS i FROM w WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM later)),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


@register("op1_substring_dedup", OP1_SQL)
def _(spark, sf_dir):
    from skyledger.llm import substring_dedup

    return substring_dedup.dedup(table(spark, sf_dir), digest=True)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(words[i + 1:i + 5], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON r.node = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = w.doc_id
"""


@register("op2_ngram_jaccard_join", OP2_SQL)
def _(spark, sf_dir):
    from skyledger.llm import jaccard_join

    return jaccard_join.join_components(table(spark, sf_dir))


OP4_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON r.node = e.a)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.root AS component_id, vec_id = c.root AS kept FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) d ON d.a = vec_id JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = vec_id
"""


@register("op4_nn_descent", OP4_SQL)
def _(spark, sf_dir):
    from skyledger.llm import nn_descent

    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS MATERIALIZED (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM (
  SELECT lang, k, array_to_string(ws[i + 1:i + k], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(ws) >= k)) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') AS first, array_to_string(ws[c + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM p)),
s AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, c, x.a AS l, y.a AS r, 1000000 * cut.a * cut.a // (x.a * y.a) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS least FROM s),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM p WHERE k = 3) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, phrase) AS rank FROM b LEFT JOIN longer ON longer.lang = b.lang AND part = phrase
  WHERE least = 1 AND (longer.a IS NULL OR 100 * longer.a < 50 * b.a))
SELECT r.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n, score::BIGINT AS score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000
"""


@register("op11_phrase_collocations", OP11_SQL)
def _(spark, sf_dir):
    from skyledger.llm import collocations

    return collocations.mine(table(spark, sf_dir))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS length FROM d WHERE len(ts) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS MATERIALIZED (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


@register("op12_best_position_search", OP12_SQL)
def _(spark, sf_dir):
    from skyledger.llm import best_position

    return best_position.search(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@register("op13_tag_path_text")
def _(spark, sf_dir):
    from skyledger.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))
