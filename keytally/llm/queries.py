"""The operators of this package as queries over whole tables, and their SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytally.llm import chat, decontamination, exact, fingerprints, language, licenses, mixing, near, repair, secrets, spelling, toxicity, urls
from keytally.llm.tables import held_out
from keytally.sources.tables import table


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.target_weights(docs))
    return mixed.select("doc_id", "source", "mix_pool", "mix_block", "mix_slot", "mix_at")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_digest(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"), counted=True)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pfair_mixing": op1_pfair_mixing,
        "op2_secrets": op2_secrets,
        "op3_licenses": op3_licenses,
        "op4_toxicity": op4_toxicity,
        "op5_spaced_seeds": op5_spaced_seeds,
        "op6_dart_minhash": op6_dart_minhash,
        "op7_url_filter": op7_url_filter,
        "op8_perspectives": op8_perspectives,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_language": op10_language,
        "op11_spelling": op11_spelling,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_fingerprints": op13_fingerprints,
    }


_EXACT = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


_CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS said,
         coalesce(nullif(regexp_replace(coalesce(role, ''), '[^A-Za-z0-9_-]', '_', 'g'), ''), 'unknown') AS plain
  FROM conversations),
names AS (
  SELECT conv_id, role, plain || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS speaker
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, plain ORDER BY role NULLS FIRST) AS k
        FROM (SELECT DISTINCT conv_id, role, plain FROM said))),
rows AS (
  SELECT s.conv_id, turn, speaker, said FROM said s JOIN names n
  ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.role IS NOT DISTINCT FROM n.role),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker NOT IN ('system', 'tool')),
both_ AS (
  SELECT r.*, p.perspective,
         CASE WHEN speaker IN ('system', 'tool') THEN '<|im_start|>' || speaker || chr(10)
              WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
  FROM rows r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, length(head) + length(said) + 11 AS len FROM both_),
placed AS (
  SELECT *, CAST(sum(len) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM sized)
SELECT conv_id, perspective, turn, speaker, head || said || '<|im_end|>' || chr(10) AS segment,
       e - len AS start, e AS "end",
       CASE WHEN speaker = perspective THEN e - len + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN e - 1 END AS mask_end
FROM placed
"""


def _url_sql(order: int = urls.ORDER) -> str:
    """The rules and the two character models, one level of the recursion per order."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    name = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    words = "|".join(urls.REJECTED_WORDS)
    start = "||".join(["chr(2)"] * order)
    levels = []
    for k in range(order + 1):
        below = "1 / 256.0::DOUBLE" if k == 0 else "l.{}"
        levels.append(f"""
s{k} AS (SELECT substr(gram, {order + 1 - k}, {k + 1}) AS s, sum(a) AS a, sum(r) AS r FROM grams GROUP BY 1),
c{k} AS (SELECT substr(s, 1, {k}) AS c, sum(a) AS na, sum(r) AS nr,
                count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM s{k} GROUP BY 1),
p{k} AS (SELECT s.s,
           CASE WHEN na > 0 THEN (s.a::DOUBLE + ta * {below.format("pa")}) / (na::DOUBLE + ta) ELSE {below.format("pa")} END AS pa,
           CASE WHEN nr > 0 THEN (s.r::DOUBLE + tr * {below.format("pr")}) / (nr::DOUBLE + tr) ELSE {below.format("pr")} END AS pr
         FROM s{k} s JOIN c{k} c ON substr(s.s, 1, {k}) = c.c {f"JOIN p{k - 1} l ON substr(s.s, 2, {k}) = l.s" if k else ""})""")
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urls._UPPER}', '{urls._LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rows AS (SELECT *, regexp_replace(host || path, '[0-9]', '0', 'g') AS shape FROM parts),
shapes AS (
  SELECT shape, count(*) AS n, bool_or(regexp_matches(host, '{words}')) AS is_rejected,
         substr(md5(shape), 1, 1) NOT IN ('0', '1', '2') AS learn FROM rows GROUP BY shape),
cut AS (SELECT shape, n, is_rejected, learn, {start} || shape || chr(3) AS padded, unnest(range(1, length(shape) + 2)) AS pos FROM shapes),
events AS (SELECT shape, substr(padded, pos, {order + 1}) AS gram,
                  CASE WHEN learn AND NOT is_rejected THEN n ELSE 0 END AS a,
                  CASE WHEN learn AND is_rejected THEN n ELSE 0 END AS r FROM cut),
grams AS (SELECT gram, sum(a) AS a, sum(r) AS r FROM events GROUP BY gram),{",".join(levels)},
scored AS (
  SELECT shape, avg(ln(pr) - ln(pa)) AS score FROM events e JOIN p{order} p ON e.gram = p.s GROUP BY shape),
means AS (
  SELECT is_rejected, sum(n * score) / sum(n) AS mean, sqrt(greatest(sum(n * score * score) / sum(n) - (sum(n * score) / sum(n)) ** 2, 0)) + 1e-9 AS dev
  FROM shapes JOIN scored USING (shape) WHERE NOT learn GROUP BY 1),
cutoff AS (SELECT (a.mean * r.dev + r.mean * a.dev) / (a.dev + r.dev) AS t
          FROM means a, means r WHERE NOT a.is_rejected AND r.is_rejected)
SELECT page_id, host, path, {name} AS rule,
       coalesce({verdict}, CASE WHEN score > coalesce((SELECT t FROM cutoff), 'infinity'::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict
FROM rows JOIN scored USING (shape)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": _url_sql(), "op8_perspectives": _CHAT, "op9_exact_dedup": _EXACT}
