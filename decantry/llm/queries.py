"""The registered queries of this subpackage and, where SQL can say it, their DuckDB twins.

Each query calls its operator over the whole table with production parameters and derives
the digest columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decantry.llm.common import table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _registered(oracle: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return keep


EXACT_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@_registered(EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.exact_dedup import exact_dedup

    docs = (table(spark, sf_dir, "documents").select("doc_id", "text")
            .withColumn("text_sha256", F.sha2(text_or_empty().cast("binary"), 256)))
    return exact_dedup(docs, carry=("text_sha256",)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


DECONTAMINATE_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM iw, LATERAL (SELECT unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i) s
  WHERE len(w) > 0),
dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM pat),
starts AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS win
           FROM dw, lens, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) s
           WHERE len(w) >= n),
hits AS (SELECT s.r, s.i, s.n, p.item_id FROM starts s JOIN pat p ON p.n = s.n AND p.win = s.win),
covered AS (SELECT r, count(DISTINCT k) AS n_hit
            FROM hits, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS k) s GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


@_registered(DECONTAMINATE_SQL)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.decontaminate import decontaminate, hit_words

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             source_size * 2 AS cap FROM s),
t AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER before, 0) AS caps_before,
             sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
      FROM w WINDOW before AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - caps_before::DOUBLE) / weight_left::DOUBLE AS level_here FROM t),
lv AS (SELECT arg_min(level_here, ratio) AS level FROM l WHERE level_here * weight <= cap),
target AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM l, lv),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM target),
hs AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
cum AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM hs)
SELECT d.doc_id, d.size, p.source_size, p.target,
       d.size * CASE WHEN p.source_size > 0
                     THEN p.whole + CASE WHEN 2 * c.below + c.words <= 2 * (p.target - p.whole * p.source_size) THEN 1 ELSE 0 END
                     ELSE 0 END AS taken
FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
       JOIN cum c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""


@_registered(MIX_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def vocab_path() -> str:
    """The public vocabulary the contract names, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


VOCAB_SIZE = 49_408


@_registered()
def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.token_file import document_index, token_file_path, write_token_file

    path = write_token_file(table(spark, sf_dir, "documents"), token_file_path(spark), vocab_path(), VOCAB_SIZE)
    return document_index(spark, path)


NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sh AS (SELECT DISTINCT r, list_slice(w, i, i + least(4, len(w)) - 1) AS s
       FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS i) x WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
inter AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach ON reach.a = w.r JOIN w o ON o.r = reach.b LEFT JOIN sizes ON sizes.r = w.r
GROUP BY w.r, w.doc_id
"""


@_registered(NGRAM_SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_registered()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@_registered()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, source, i, parts[i] AS raw, trim(parts[i], ' ' || chr(9) || chr(13)) AS line
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) s),
boiler AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(raw, chr(10) ORDER BY i) AS t
         FROM l WHERE line NOT IN (SELECT line FROM boiler) GROUP BY r)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(len(parts) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@_registered(LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_registered()
def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.pseudonyms import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="decantry-pseudonyms-1").select("doc_id", "n_replaced", "text")


@_registered()
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@_registered()
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.labelled import held_out
    from decantry.llm.ngram_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 7, 2))


def _ways_sql() -> str:
    """(symbol, from, to, cost, audit) of one row and the inserts before it, as SQL values."""
    from decantry.llm.grammar_dp import TERMINAL_WAYS

    return ", ".join(f"({s},{i},{j},{cost},'{audit}')" for s, ways in enumerate(TERMINAL_WAYS)
                     for (i, j), (cost, audit) in sorted(ways.items()))


# Two walks, a row and an edit a step: costs and least audits of the four states, then the repaired lines.
CONVERSATIONS_SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([b::BIGINT] || range(0, 8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM range(0, 256) r(b)),
lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce('=' || conv_id, '-') AS c,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                                                lambda x: ord(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot
  FROM conversations, tab),
hurt AS (
  SELECT c, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM lots, range(0, 2) k(copy) WHERE lot <> 0 AND (copy = 0 OR lot = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS rn,
                  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY rn) > 1 THEN 2
                          WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
                  CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind,
                  lag(left(role, 1)) OVER (PARTITION BY c ORDER BY rn) AS before FROM placed),
signs AS (SELECT *, CASE WHEN fault IN (1, 2) THEN 8 WHEN fault = 3 THEN kind + 4 ELSE kind END AS sign FROM faulty),
ways AS (SELECT sign, list({{'i': i, 'j': j, 'cost': cost, 'a': a}}) AS w FROM (VALUES {_ways_sql()}) v(sign, i, j, cost, a) GROUP BY sign),
walk(c, pos, st) AS (
  SELECT DISTINCT c, 0::BIGINT, [{{'cost': 0::BIGINT, 'a': ''}}, {{'cost': 1000000000::BIGINT, 'a': ''}},
                                 {{'cost': 1000000000::BIGINT, 'a': ''}}, {{'cost': 1000000000::BIGINT, 'a': ''}}] FROM signs
  UNION ALL
  SELECT walk.c, pos + 1, list_transform(range(0, 4), lambda j:
         coalesce(list_sort(list_transform(list_filter(w, lambda x: x.j = j AND st[x.i + 1].cost < 1000000000),
                                           lambda x: {{'cost': st[x.i + 1].cost + x.cost, 'a': st[x.i + 1].a || x.a}}))[1],
                  {{'cost': 1000000000::BIGINT, 'a': ''}}))
  FROM walk JOIN signs ON signs.c = walk.c AND signs.rn = pos + 1 JOIN ways USING (sign)),
solved AS (
  SELECT c, list_sort([{{'cost': st[1].cost, 'a': st[1].a}}, {{'cost': st[2].cost + 10, 'a': st[2].a || 'II'}},
                       {{'cost': st[3].cost + 5, 'a': st[3].a || 'I'}}, {{'cost': st[4].cost, 'a': st[4].a}}])[1] AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY c ORDER BY pos DESC) = 1),
source AS (SELECT c, list(role ORDER BY rn) AS roles, list(text ORDER BY rn) AS texts FROM signs GROUP BY c),
edit(c, n, state, pos, lines) AS (
  SELECT c, 0::BIGINT, 0, 1::BIGINT, ['']::VARCHAR[] FROM solved
  UNION ALL
  SELECT edit.c, n + 1,
         CASE a[n + 1] WHEN 'D' THEN state WHEN 'K' THEN CASE left(roles[pos], 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
                       ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END,
         CASE a[n + 1] WHEN 'I' THEN pos ELSE pos + 1 END,
         CASE a[n + 1] WHEN 'D' THEN lines WHEN 'K' THEN lines || [roles[pos] || ':' || texts[pos]]
                       ELSE lines || [CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE a[n + 1] WHEN 'R' THEN texts[pos] ELSE '' END] END
  FROM edit JOIN (SELECT c, best.a AS a FROM solved) s ON s.c = edit.c JOIN source ON source.c = edit.c WHERE n < length(a)),
done AS (SELECT c, sha256(array_to_string(lines[2:], chr(10))) AS sha FROM edit QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC) = 1),
told AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
                count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM signs GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM lots) o LEFT JOIN told USING (c) LEFT JOIN solved USING (c) LEFT JOIN done USING (c)
"""


@_registered(CONVERSATIONS_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decantry.llm.conversations import conversation_key, damaged, digests, repair_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = repair_conversations(damaged(rows))
    every = rows.select("conv_id", conversation_key().alias("c")).distinct()
    found = repair.report.drop("conv_id").join(digests(repair.chunks), "c", "left")
    number = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "c", "left").select("conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"),
                                                 F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@_registered()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from decantry.llm.token_alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))
