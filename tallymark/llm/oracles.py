"""SQL of the queries that SQL can express as a whole."""

from __future__ import annotations

from tallymark.llm.secret_scan import ADDED, BASE, KINDS, LEAST, LONG_ONLY


def secrets_sql() -> str:
    """Every rule searched in every text, without an index."""
    parts = []
    for kind, pattern in (BASE | ADDED).items():
        said = LONG_ONLY.get(kind, pattern).replace("'", "''")
        group = 2 if kind == "assign" else 0
        parts.append(
            f"SELECT doc_id, n, '{kind}' AS kind, {KINDS.index(kind)} AS rank, {LEAST.get(kind, 0)} AS least, string_split_regex(t, '{said}') AS gaps, regexp_extract_all(t, '{said}') AS found, regexp_extract_all(t, '{said}', {group}) AS part FROM d"
        )
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
every AS ({" UNION ALL ".join(parts)}),
one AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM every WHERE len(found) > 0),
placed AS (SELECT n, kind, rank, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a, length(found[i]) AS size FROM one WHERE length(part[i]) >= least),
spans AS (SELECT n, kind, rank, CAST(a AS BIGINT) AS a, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + size AS BIGINT) AS VARCHAR) AS said FROM placed),
listed AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(said, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(said, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (n)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": secrets_sql()}
