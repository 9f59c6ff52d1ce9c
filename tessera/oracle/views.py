"""DuckDB twins of the fixture views, as named CTEs.

``sql(body, *names)`` prepends the CTEs ``names`` need (dependencies first)
to a query ``body``.  The recursive indicators are a recursive CTE, i.e. an
independent computation of what ``operators.series.ewm`` does by block scan.
"""

from __future__ import annotations

# Characters stripped at both ends of texts (same set as functions.text.WS).
WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_TIE = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), f"""bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day,
         arg_min(100 + l_quantity / 10, {_TIE}) AS open,
         max(100 + l_quantity / 10) AS high,
         min(100 + l_quantity / 10) AS low,
         arg_max(100 + l_quantity / 10, {_TIE}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""),
    "vol": ((), """vol AS (
  SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 10000 AS vix_close
  FROM orders GROUP BY 1)"""),
    "rets": (("bars",), """rets AS (
  SELECT * FROM (
    SELECT *, 100 * ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r
    FROM bars) WHERE r IS NOT NULL)"""),
    "jn": (("rets", "vol"), """jn AS (
  SELECT rets.*, vol.vix_close,
         row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i
  FROM rets JOIN vol USING (day))"""),
    "ind1": (("jn",), """ind1 AS (
  SELECT *,
    CASE WHEN close - pc > 0 THEN close - pc ELSE 0.0 END AS up,
    CASE WHEN close - pc < 0 THEN pc - close ELSE 0.0 END AS dn,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN n20 = 20 AND sd20 <> 0 THEN (close - (m20 - 2 * sd20)) / (4 * sd20) END AS bb_pct,
    100 * (volume / pv - 1) AS vol_change
  FROM (
    SELECT *, lag(close) OVER w AS pc, lag(volume) OVER w AS pv,
      count(close) OVER w20 AS n20, avg(close) OVER w20 AS m20, stddev_pop(close) OVER w20 AS sd20,
      CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma_20,
      CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_50
    FROM jn
    WINDOW w AS (PARTITION BY symbol ORDER BY i),
           w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
           w50 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"""),
    "ind2": (("ind1",), """ind2 AS (
  SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS tr14
  FROM ind1)"""),
    "rec": (("ind2",), """rec(symbol, i, eu, ed, ef, es, atr, sig) AS (
  SELECT symbol, i, up, dn, close, close, CASE WHEN i = 13 THEN tr14 ELSE 0.0 END, CAST(NULL AS DOUBLE)
  FROM ind2 WHERE i = 0
  UNION ALL
  SELECT d.symbol, d.i,
    e.eu * 13 / 14 + d.up / 14,
    e.ed * 13 / 14 + d.dn / 14,
    e.ef * 11 / 13 + d.close * 2 / 13,
    e.es * 25 / 27 + d.close * 2 / 27,
    CASE WHEN d.i < 13 THEN 0.0 WHEN d.i = 13 THEN d.tr14 ELSE (e.atr * 13 + d.tr) / 14 END,
    CASE WHEN d.i = 25 THEN (e.ef * 11 / 13 + d.close * 2 / 13) - (e.es * 25 / 27 + d.close * 2 / 27)
         WHEN d.i > 25 THEN e.sig * 0.8 + 0.2 * ((e.ef * 11 / 13 + d.close * 2 / 13) - (e.es * 25 / 27 + d.close * 2 / 27))
    END
  FROM rec e JOIN ind2 d ON d.symbol = e.symbol AND d.i = e.i + 1)"""),
    "ind": (("rec",), """ind AS (
  SELECT ind2.*,
    CASE WHEN ind2.i >= 13 THEN CASE WHEN rec.ed = 0 THEN 100.0 ELSE 100 - 100 / (1 + rec.eu / rec.ed) END END AS rsi_14,
    CASE WHEN ind2.i >= 25 THEN rec.ef - rec.es END AS macd,
    CASE WHEN ind2.i >= 33 THEN rec.sig END AS macd_signal,
    CASE WHEN ind2.i >= 33 THEN rec.ef - rec.es - rec.sig END AS macd_diff,
    rec.atr AS atr_14
  FROM ind2 JOIN rec USING (symbol, i))"""),
    "feat": (("ind",), """feat AS (
  SELECT symbol, day, open, high, low, close, volume, r, vix_close, rsi_14, macd, macd_signal, macd_diff,
         bb_pct, atr_14, sma_20, sma_50, vol_change,
         row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i
  FROM ind
  WHERE vix_close IS NOT NULL AND rsi_14 IS NOT NULL AND macd IS NOT NULL AND macd_signal IS NOT NULL
    AND macd_diff IS NOT NULL AND bb_pct IS NOT NULL AND atr_14 IS NOT NULL AND sma_20 IS NOT NULL
    AND sma_50 IS NOT NULL AND vol_change IS NOT NULL)"""),
    "rpos": (("rets",), """rpos AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM rets)"""),
    "preds": (("rpos",), """preds AS (
  WITH p AS (
    SELECT symbol, day, r,
      CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5
           THEN avg(r) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS mom,
      lead(r, 1) OVER (PARTITION BY symbol ORDER BY i) AS y1,
      CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5
           THEN sum(r) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS y5
    FROM rpos)
  SELECT m.model, h.horizon, p.symbol, p.day,
         CASE WHEN h.horizon = 1 THEN p.y1 ELSE p.y5 END AS y_true,
         CASE m.model WHEN 'momentum' THEN p.mom WHEN 'reversal' THEN -p.r ELSE 0.0 END AS y_pred
  FROM p, (VALUES ('momentum'), ('reversal'), ('zero')) m(model), (VALUES (1), (5)) h(horizon)
  WHERE p.mom IS NOT NULL AND (CASE WHEN h.horizon = 1 THEN p.y1 ELSE p.y5 END) IS NOT NULL)"""),
    "bpos": (("bars",), """bpos AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i FROM bars)"""),
    "ewm12": (("bpos",), """ewm12(symbol, i, v) AS (
  SELECT symbol, i, close FROM bpos WHERE i = 0
  UNION ALL
  SELECT p.symbol, p.i, e.v * 11 / 13 + p.close * 2 / 13 FROM ewm12 e JOIN bpos p ON p.symbol = e.symbol AND p.i = e.i + 1)"""),
    "news": ((), """news AS (
  SELECT source, CAST(substr(source, 4) AS INTEGER) AS src_rank, doc_id AS row_no,
         DATE '1995-01-02' + CAST(n_chars % 250 AS INTEGER) AS day,
         split_part(text, chr(10), 1) AS headline,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body
  FROM documents)"""),
    "clean": (("news",), f"""clean AS (
  SELECT source, src_rank, row_no, day, trim(headline, {WS}) AS headline, trim(coalesce(body, ''), {WS}) AS body
  FROM news WHERE day IS NOT NULL AND headline IS NOT NULL AND trim(headline, {WS}) <> '')"""),
    "dedup": (("clean",), """dedup AS (
  SELECT source, src_rank, row_no, day, headline, body FROM (
    SELECT *, row_number() OVER (PARTITION BY day, headline ORDER BY src_rank, row_no) AS rn FROM clean)
  WHERE rn = 1)"""),
    "nvec": (("news",), """nvec AS (
  SELECT n.row_no, n.day, n.headline, e.embedding AS emb
  FROM news n JOIN embeddings e ON e.vec_id = n.row_no % (SELECT count(*) FROM embeddings))"""),
    "trials": ((), """trials AS (
  SELECT CAST((p_partkey - 1) // 3 AS BIGINT) AS trial,
         CAST((p_partkey - 1) % 3 AS INTEGER) AS fold,
         CASE WHEN p_size = 50 THEN NULL ELSE round(p_retailprice / 1000 + p_size / 500.0, 6) END AS loss,
         CAST(64 * pow(2, ((p_partkey - 1) // 3) % 3) AS INTEGER) AS hidden,
         CAST(32 * pow(2, (((p_partkey - 1) // 3) // 3) % 3) AS INTEGER) AS d_model,
         CAST(round(0.1 + (((p_partkey - 1) // 3) % 9) * 0.05, 6) AS DOUBLE) AS dropout,
         round(1e-6 * pow(10.0, ((p_partkey - 1) // 3) % 4), 12) AS weight_decay
  FROM part)"""),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for dep in CTES[n][0]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(body: str, *names: str, extra: str | None = None) -> str:
    """``WITH RECURSIVE <ctes>[, <extra>] <body>`` (RECURSIVE is harmless otherwise)."""
    parts = [CTES[n][1] for n in _order(names)] + ([extra] if extra else [])
    if not parts:
        return body
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
