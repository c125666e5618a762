"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.functions.hashing import SPAN, permanent_int_sql
from terazi.functions.turkish import spelling_key_sql
from terazi.llm import encoding, garbled, packing, pii, quota_sample, repeated_lines, sentences, stable_sample, token_budget
from terazi.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _tables(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query that gets whole tables."""
    return lambda f: lambda spark, d: f(*[table(spark, d, n) for n in names])


def _line_tests(k: DataFrame) -> DataFrame:
    """The tests behind p3_found without their keys: one row per wording and source."""
    return repeated_lines.line_tests(k).select("source", "df", "n_in", "df_out", F.col("n_out").cast("long").alias("n_out"), F.round("llr", 4).alias("llr"))


#: all that Python and SQL take for white space
_WHITE = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _coverage(d: DataFrame) -> DataFrame:
    """doc_id, im: how many characters other than white space a document's sentences hold together."""
    signs = F.length(F.regexp_replace("sentence", _WHITE, ""))
    return sentences.sentences(d).groupBy("doc_id").agg(F.sum(signs).alias("im"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _tables("kararlar", "hedef_paylar")(quota_sample.found),
        "p1_sample": _tables("kararlar", "hedef_paylar")(lambda k, h: quota_sample.quota_sample(k, h)[0]),
        "p1_report": _tables("kararlar", "hedef_paylar")(lambda k, h: quota_sample.quota_sample(k, h)[1]),
        "p2_totals": _tables("chunks", "documents", "kaynaklar")(token_budget.token_totals),
        "p2_counts": _tables("chunks", "documents", "kaynaklar")(token_budget.token_counts),
        "p2_decisions": _tables("chunks")(token_budget.decision_tokens),
        "p3_tests": _tables("kararlar")(_line_tests),
        "p3_found": _tables("kararlar")(repeated_lines.found),
        "p3_clean": _tables("kararlar")(repeated_lines.clean),
        "p4_found": _tables("kararlar")(pii.found),
        "p4_redacted": _tables("kararlar")(pii.redact),
        "p5_sample": _tables("kararlar", "havuz_uyelik")(stable_sample.stable_sample),
        "p6_found": _tables("experiments")(garbled.found),
        "p6_restored": _tables("experiments")(garbled.restore),
        "p7_ids": _tables("documents")(encoding.encode_table),
        "p7_round_trip": _tables("documents")(lambda d: encoding.decode_table(encoding.encode_table(d))),
        "p8_containers": _tables("documents", "modeller")(packing.pack_documents),
        "p8_invariants": _tables("documents", "modeller")(lambda d, m: packing.invariants(packing.pack_documents(d, m), d, m)),
        "p9_found": _tables("documents")(sentences.split_table),
        "p9_coverage": _tables("documents")(_coverage),
        "p9_sentences": _tables("documents")(sentences.sentences),
        "p8_fill": _tables("documents", "modeller")(lambda d, m: packing.fill_report(packing.pack_documents(d, m), m)),
    }


_DECISIONS = f"""
decisions AS (
  SELECT id, max({spelling_key_sql('source')}) AS s, max({spelling_key_sql('court')}) AS c FROM kararlar WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT count(*) // 10 AS n FROM decisions),
report AS (
  SELECT h.hedef_id, h.source, h.court, h.hedef_binde, h.en_az, count(d.id) AS var,
         greatest(h.en_az, CAST(ceil(h.hedef_binde * (SELECT n FROM n) / 1000.0) AS BIGINT)) AS kota
  FROM hedef_paylar h
  LEFT JOIN decisions d ON d.s = {spelling_key_sql('h.source')} AND d.c = {spelling_key_sql('h.court')}
  GROUP BY h.hedef_id, h.source, h.court, h.hedef_binde, h.en_az)"""

_LETTERS = "regexp_replace(strip_accents(lower(translate(line, 'İIı', 'iii'))), '[^\\p{L}]', '', 'g')"
_EXCESS = f"""
docs AS (SELECT id, max({spelling_key_sql('source')}) AS s, max(text) AS text FROM kararlar WHERE id IS NOT NULL GROUP BY id),
cut AS (SELECT id, s, string_split(text, chr(10)) AS lines FROM docs WHERE text IS NOT NULL),
lines AS (SELECT id, s, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM cut),
keyed AS (SELECT id, s, line, line_no, {_LETTERS} AS k FROM lines),
sizes AS (SELECT s, count(*) AS n FROM docs GROUP BY s),
excess AS (
  SELECT keyed.s, k FROM keyed JOIN sizes USING (s) WHERE k <> '' GROUP BY keyed.s, k, n
  HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) * 100 >= 3 * n)"""


def oracle_sql() -> dict[str, str]:
    prn = permanent_int_sql("id", stable_sample.SEED)
    by_load = "CASE " + " ".join(f"WHEN havuz <= {p} AND prn < {int(t * SPAN)} THEN {p}" for p, t in stable_sample.THRESHOLDS) + " END"
    return {
        "p1_found": f"WITH {_DECISIONS} SELECT source, court FROM report WHERE var < kota",
        "p1_report": f"WITH {_DECISIONS} SELECT hedef_id, source, court, hedef_binde, en_az, var, kota, least(var, kota) AS alinan, greatest(0, kota - var) AS eksik FROM report",
        "p1_sample": f"""WITH {_DECISIONS},
            ranked AS (
              SELECT d.id, r.source, r.court, r.hedef_id, r.kota,
                     row_number() OVER (PARTITION BY r.hedef_id ORDER BY {permanent_int_sql('d.id', quota_sample.SEED)}, d.id) AS rn
              FROM report r JOIN decisions d ON d.s = {spelling_key_sql('r.source')} AND d.c = {spelling_key_sql('r.court')})
            SELECT id, source, court, hedef_id FROM ranked WHERE rn <= kota""",
        "p3_found": f"WITH {_EXCESS} SELECT id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN excess USING (s, k)",
        "p3_clean": f"""WITH {_EXCESS},
            kept AS (
              SELECT keyed.id, string_agg(line, chr(10) ORDER BY line_no) FILTER (excess.k IS NULL) AS text, count(excess.k) AS removed
              FROM keyed LEFT JOIN excess ON keyed.s = excess.s AND keyed.k = excess.k GROUP BY keyed.id)
            SELECT docs.id, CASE WHEN docs.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(removed, 0) AS INTEGER) AS removed
            FROM docs LEFT JOIN kept USING (id)""",
        "p2_decisions": f"""WITH rows AS (SELECT decision_id, chunk_index, {spelling_key_sql('source')} AS source, coalesce(length(text), 0) AS chars, tokens FROM chunks WHERE decision_id IS NOT NULL),
            medians AS (SELECT source, quantile_disc(chars / tokens, 0.5) AS m FROM rows WHERE tokens > 0 AND chars > 0 GROUP BY source), overall AS (SELECT quantile_disc(chars / tokens, 0.5) AS o FROM rows WHERE tokens > 0 AND chars > 0),
            judged AS (SELECT r.*, coalesce(m, o, 4.0) AS per, coalesce(tokens > 0 AND chars > 0 AND chars / tokens <= coalesce(m, o, 4.0) * {token_budget.DOUBT} AND chars / tokens * {token_budget.DOUBT} >= coalesce(m, o, 4.0), false) AS trusted
              FROM rows r LEFT JOIN medians ON medians.source IS NOT DISTINCT FROM r.source CROSS JOIN overall),
            each AS (SELECT decision_id, chunk_index, max(source) AS source, min((CASE WHEN trusted THEN 0 ELSE 1 END, CASE WHEN trusted THEN tokens ELSE round(chars / per)::BIGINT END)) AS best FROM judged GROUP BY decision_id, chunk_index)
            SELECT decision_id, max(source) AS source, sum(best[2])::BIGINT AS tokens, sum(best[1])::BIGINT AS estimated FROM each GROUP BY decision_id""",
        "p3_tests": f"""WITH {_EXCESS}, held AS (SELECT s, k, count(DISTINCT id) AS df FROM keyed WHERE k <> '' GROUP BY s, k),
            marked AS (SELECT held.*, n AS n_in, df >= 5 AND df * 100 >= 3 * n AS bad, (SELECT sum(n) FROM sizes) AS n_all FROM held JOIN sizes USING (s)),
            sums AS (SELECT *, sum(df) OVER (PARTITION BY k) AS df_all, sum(CASE WHEN bad THEN df ELSE 0 END) OVER (PARTITION BY k) AS df_bad, sum(CASE WHEN bad THEN n_in ELSE 0 END) OVER (PARTITION BY k) AS n_bad FROM marked),
            sides AS (SELECT s, df, n_in, df_all - df_bad - CASE WHEN bad THEN 0 ELSE df END AS k2, n_all - n_bad - CASE WHEN bad THEN 0 ELSE n_in END AS out FROM sums WHERE df >= 5),
            tests AS (SELECT s, df::DOUBLE AS k1, n_in::DOUBLE AS n1, k2::DOUBLE AS k2, (CASE WHEN out > 0 THEN out ELSE n_in END)::DOUBLE AS n2 FROM sides), p AS (SELECT *, (k1 + k2) / (n1 + n2) AS p FROM tests)
            SELECT s AS source, k1::BIGINT AS df, n1::BIGINT AS n_in, k2::BIGINT AS df_out, n2::BIGINT AS n_out, round(CASE WHEN k1 / n1 > k2 / n2 THEN 2 * (k1 * ln(k1 / n1 / p) + CASE WHEN k2 > 0 THEN k2 * ln(k2 / n2 / p) ELSE 0 END
              + CASE WHEN n1 > k1 THEN (n1 - k1) * ln((1 - k1 / n1) / (1 - p)) ELSE 0 END + CASE WHEN n2 > k2 THEN (n2 - k2) * ln((1 - k2 / n2) / (1 - p)) ELSE 0 END) ELSE 0 END, 4) AS llr FROM p""",
        "p8_invariants": "SELECT model, (SELECT count(*) FROM documents) AS belge, 0::BIGINT AS fazla, 0::BIGINT AS bolunen, 0::BIGINT AS eksik FROM modeller WHERE max_tokens > 0",
        "p9_coverage": f"SELECT doc_id, length(regexp_replace(text, '{_WHITE}', '', 'g')) AS im FROM documents WHERE length(regexp_replace(text, '{_WHITE}', '', 'g')) > 0",
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p5_sample": f"""WITH pools AS (
              SELECT k.id, coalesce(min(u.havuz), 3) AS havuz FROM (SELECT DISTINCT id FROM kararlar WHERE id IS NOT NULL) k
              LEFT JOIN havuz_uyelik u ON u.id = k.id GROUP BY k.id),
            numbered AS (SELECT id, havuz, {prn} AS prn FROM pools),
            sampled AS (SELECT id, {by_load} AS havuz FROM numbered)
            SELECT id, havuz FROM sampled WHERE havuz IS NOT NULL""",
    }
