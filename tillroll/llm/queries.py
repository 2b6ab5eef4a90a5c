"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import chat, decontam, exact, licenses, lines, mixing, negatives, ngram_join, quality, substring, toxicity, urls, whitening
from .shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- 4 licences
# The documents as a file tree: <source>/<doc_id / 2000>/<doc_id / 100>/<file>;
# every fifth file is a licence file, some of them further up.
FILE_PATH = """concat(coalesce(source, 'none'),
  CASE WHEN doc_id % 35 = 0 THEN '' ELSE concat('/m', cast(floor(doc_id / 2000) AS bigint)) END,
  CASE WHEN doc_id % 35 = 0 OR doc_id % 15 = 0 THEN '' ELSE concat('/p', cast(floor(doc_id / 100) AS bigint)) END,
  CASE WHEN doc_id % 5 = 0 THEN concat('/LICENSE.', doc_id) ELSE concat('/f', doc_id, '.txt') END)"""


def _license_oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    given = ", ".join(f"({k}, {quote(name)}, {quote(t)})" for k, (name, text) in enumerate(licenses.TEMPLATES) for t in licenses.terms(text))
    w, n = licenses, licenses.BEFORE
    return rf"""
WITH files AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), '{w.UPPER}', '{w.LOWERED}') AS low,
  {FILE_PATH.replace("cast(floor(doc_id / 2000) AS bigint)", "doc_id // 2000").replace("cast(floor(doc_id / 100) AS bigint)", "doc_id // 100")} AS path FROM documents),
total AS (SELECT count(*) AS n FROM files),
words AS (SELECT term, count(*) AS files FROM (SELECT unnest(list_distinct(regexp_split_to_array(low, '{w.SPLIT}'))) AS term FROM files) WHERE term <> '' GROUP BY term),
given(k, name, term) AS (VALUES {given}),
lines AS (SELECT doc_id, regexp_split_to_array(low, '{w.BREAKS}') AS lines FROM files WHERE regexp_matches(low, '{w.TELLING_LINE}')),
numbered AS (SELECT doc_id, unnest(range(1, len(l.lines) + 1)) AS i, unnest(l.lines) AS line FROM lines l),
telling AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS earlier FROM numbered WHERE regexp_matches(line, '{w.TELLING_LINE}')),
starts AS (SELECT doc_id, i, 1 AS len FROM telling
  UNION SELECT doc_id, greatest(i - back, 1), len FROM telling, (SELECT unnest(range(0, {n} + 1)) AS back), (SELECT unnest({list(w.LENGTHS)}) AS len)
  WHERE earlier IS NULL OR i - earlier > {n}),
blocks AS (SELECT doc_id, array_to_string(list_sort(list_filter(regexp_split_to_array(array_to_string(l.lines[i:i + len - 1], ' '), '{w.SPLIT}'), lambda t: t <> '')), ' ') AS block
  FROM starts JOIN lines l USING (doc_id)),
found AS (SELECT DISTINCT doc_id, block FROM blocks WHERE block <> ''),
tf AS (SELECT block, term, count(*) AS tf FROM (SELECT block, unnest(string_split(block, ' ')) AS term FROM (SELECT DISTINCT block FROM found)) GROUP BY ALL),
unit AS (SELECT block, term, tf * (ln((n + 1) / (coalesce(files, 0) + 1)) + 1) AS weight FROM tf LEFT JOIN words USING (term), total),
model AS (SELECT k, name, term, tf * (ln((n + 1) / (coalesce(files, 0) + 1)) + 1) AS part FROM (SELECT k, name, term, count(*) AS tf FROM given GROUP BY ALL) LEFT JOIN words USING (term), total),
norms AS (SELECT block, sqrt(sum(weight * weight)) AS norm FROM unit GROUP BY block),
lengths AS (SELECT k, sqrt(sum(part * part)) AS length FROM model GROUP BY k),
dots AS (SELECT block, k, name, sum(weight * part) AS dot FROM unit JOIN model USING (term) GROUP BY ALL),
scores AS (SELECT block, name, max(round(dot / norm / length, 6)) AS score FROM dots JOIN norms USING (block) JOIN lengths USING (k) GROUP BY block, name),
ranked AS (SELECT block, name, score, row_number() OVER r AS place, lead(score) OVER r AS rival FROM scores WINDOW r AS (PARTITION BY block ORDER BY score DESC, name DESC)),
named AS (SELECT block, name, score FROM ranked WHERE place = 1 AND score >= {w.THRESHOLD} AND round(score - coalesce(rival, 0), 6) >= {w.MARGIN}),
best AS (SELECT doc_id, arg_max(name, (score, name)) AS name, max(score) AS score FROM found JOIN named USING (block) GROUP BY doc_id),
spdx AS (SELECT doc_id, nullif(regexp_extract(text, '{w.SPDX}', 1), '') AS spdx FROM files),
scanned AS (SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
  coalesce(spdx, b.name) AS own_license, CASE WHEN spdx IS NOT NULL THEN 1.0 ELSE b.score END AS own_score
  FROM files f JOIN spdx USING (doc_id) LEFT JOIN best b USING (doc_id)),
given_up AS (SELECT dir AS up, arg_min(own_license, (-own_score, own_license)) AS given FROM scanned WHERE own_license IS NOT NULL AND name LIKE 'LICENSE%' GROUP BY dir),
near AS (SELECT s.dir, max((length(up), up, given)) AS near FROM (SELECT DISTINCT dir FROM scanned) s JOIN given_up ON s.dir = up OR starts_with(s.dir, up || '/') GROUP BY s.dir)
SELECT doc_id, path, own_license, CAST(own_score AS DOUBLE) AS own_score, coalesce(own_license, near[3]) AS license,
       CASE WHEN own_license IS NULL THEN near[2] END AS license_dir
FROM scanned LEFT JOIN near USING (dir)"""


@register(_license_oracle())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir).select("doc_id", "text", F.expr(FILE_PATH).alias("path"))
    return licenses.scan_tree(files, keep=["doc_id", "path"])


# ------------------------------------------------------------- 5 exact dedup
@register(r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


# --------------------------------------------------------- 6 chat formatting
@register(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS body, replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS head FROM c),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, CAST(sum(length(body) + length(head) + 14) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM s""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    rows = chat.chain(rows, "conv_id", ["turn", "role", "text"]).withColumn("points", F.length("text"))
    out = chat.format_trees(rows, "conv_id", "node", "parent", score_col="points")
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


# ------------------------------------------------------------------ 8 mixing



@register(r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(text, '')) AS mark,
  md5(coalesce(CAST(doc_id AS VARCHAR), ':' || md5(coalesce(text, ''))) || ':17') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (SELECT *, cap / weight AS per, greatest(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0), 0) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN per <= level OR (SELECT max(level) FROM l WHERE per > level) IS NULL THEN cap ELSE (SELECT max(level) FROM l WHERE per > level) * weight END AS target FROM l),
p AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS budget FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
r AS (SELECT d.*, q.source_size, q.target, q.epochs, q.budget - q.epochs * q.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 6) AS target, CAST(epochs * size + least(greatest(rest - before, 0), size) AS BIGINT) AS taken FROM r""")
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import stored
    sized = stored(documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), mixing.text_mark(F.col("text")).alias("mark")), "mix-sizes")
    out = mixing.mix(sized, size=F.col("words"), mark=F.col("mark"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


# ------------------------------------------------------------ 10 line dedup
@register(r"""
WITH l AS (SELECT doc_id, pos, line, lower_ascii AS key FROM (
    SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare,
           translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))),
k AS (SELECT key, max(doc_id) AS stays FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, (k.key IS NOT NULL AND doc_id <> stays) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256 FROM m GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(documents(spark, sf_dir), columns=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


# ------------------------------------------------------- 7 decontamination
@register()
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_hits(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), columns=["doc_id"])
    n_hit = decontam.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# ------------------------------------------------- 3 quality and 9 toxicity
def _fold(modulus: int) -> Column:
    """crc32 of doc_id as text modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


@register()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels").filter(_fold(5) != 0)
    out = quality.score_quality(documents(spark, sf_dir), labels)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


@register()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels").filter(_fold(4) != 2)
    out = toxicity.score_toxicity(documents(spark, sf_dir), labels)
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= toxicity.CUT, 1).otherwise(0).alias("predicted"))


# -------------------------------------------------------- 2 substring dedup
@register()
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(documents(spark, sf_dir), columns=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# ---------------------------------------------------- 1 n-gram Jaccard join
@register()
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


# ------------------------------------------------------------ 13 url filters
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def _url_oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return rf"""
WITH r(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWERED}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM (SELECT DISTINCT host, path FROM s) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN b ON s.host = b.host AND s.path = b.path"""


@register(_url_oracle())
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark, URL_RULES), columns=["page_id"])


# ------------------------------------------------------ 11 embedding whitening
@register()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(documents(spark, sf_dir, "embeddings"), columns=["vec_id"])
    each = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "of"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"),
                       F.col("of.explained").alias("explained"), "identity_error")


# --------------------------------------------------- 12 hard-negative mining
@register()
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings").filter(negatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), negatives.whole_numbers(F.col("embedding")).alias("vector"))
    return negatives.mine_negatives(rows, F.col("vec_id") % 100 == 0)


# ------------------------------------------------------------------ pipeline
@register(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
