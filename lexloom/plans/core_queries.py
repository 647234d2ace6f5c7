"""Queries on processing only new or changed records."""

from __future__ import annotations

from lexloom.operators.incremental import changed_records, replay_ledger
from lexloom.sources.tables import table


def p1_found(spark, d):
    """The versions each succeeded run takes, from the replayed ledger."""
    return changed_records(table(spark, d, "corpus_version"), table(spark, d, "corpus_run"))


def p1_ledger(spark, d):
    """How the ledger stands for every delivered write: its state, the run that finished it and the leases it took."""
    w = table(spark, d, "corpus_version").select("version_id", "write_seq", "landed_at")
    return replay_ledger(w, table(spark, d, "corpus_run")).groupBy("ledger_state", "leases").count().withColumnRenamed("count", "writes")


P1_SQL = """
WITH runs AS (
  SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS n
  FROM corpus_run WHERE outcome = 'succeeded' AND run_id IS NOT NULL AND started_at IS NOT NULL
), w AS (
  SELECT version_id, landed_at, write_seq, CAST(CASE WHEN regexp_matches(updated_at, '(Z|[+-][0-9]{2}(:?[0-9]{2})?)$') THEN updated_at ELSE updated_at || 'Z' END AS TIMESTAMPTZ) AS t,
    CAST(struct_pack(a := law_id, b := economy, c := version_key, d := amendment_date, e := content_sha256, f := body_path, g := fmt, h := bytes, i := pages, j := chars,
      k := fetched_at, l := etag, m := ocr_used, n := ocr_provider, o := cer, p := extraction_version, q := provisions_n, r := state, s := error, u := superseded_by) AS VARCHAR) AS body
  FROM corpus_version WHERE version_id IS NOT NULL
), cur AS (
  SELECT r.run_id, r.n, w.version_id, w.body,
    row_number() OVER (PARTITION BY r.run_id, w.version_id ORDER BY w.t DESC NULLS LAST, w.write_seq DESC NULLS LAST) AS k
  FROM runs r JOIN w ON w.landed_at <= r.started_at
), now_ AS (SELECT * FROM cur WHERE k = 1),
prev AS (SELECT *, lag(body) OVER (PARTITION BY version_id ORDER BY n) AS before, row_number() OVER (PARTITION BY version_id ORDER BY n) AS nth FROM now_)
SELECT run_id, version_id FROM prev WHERE nth = 1 OR body <> before
"""

LEDGER_SQL = """
WITH runs AS (SELECT *, row_number() OVER (ORDER BY started_at, run_id) AS n FROM corpus_run WHERE run_id IS NOT NULL AND started_at IS NOT NULL),
w AS (SELECT row_number() OVER () AS i, landed_at FROM corpus_version),
j AS (SELECT w.i, min(r.n) AS a, min(CASE WHEN r.outcome = 'succeeded' THEN r.n END) AS b FROM w LEFT JOIN runs r ON r.started_at >= w.landed_at GROUP BY w.i)
SELECT CASE WHEN b IS NOT NULL THEN 'done' WHEN a IS NOT NULL THEN 'leased' ELSE 'pending' END AS ledger_state, CAST(b - a + 1 AS INT) AS leases, count(*) AS writes FROM j GROUP BY 1, 2
"""

QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger}
ORACLE = {"p1_found": P1_SQL, "p1_ledger": LEDGER_SQL}
