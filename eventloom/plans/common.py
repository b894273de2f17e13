"""What the query modules share: the adapters' SQL, and a register of queries."""

from __future__ import annotations

from collections.abc import Callable

#: Events as intervals, predictions and vectors, as DuckDB sees them.
EV = """ev AS (SELECT user_id AS clip, event_id AS call_id, event_type AS label, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS start_s,
  date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 + value AS end_s, event_type IN ('purchase', 'click') AS focal, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
PR = """pr AS (SELECT d.doc_id AS call_id, d.source AS clip, d.lang AS label, TRY_CAST(nullif(regexp_extract(d.source, '(\\d+)$', 1), '') AS INTEGER) % 5 + 1 AS fold, t.target,
  CASE t.target WHEN 'post' THEN l.quality ELSE l.toxic END AS y, 1 / (1 + exp(-(d.n_chars - 1500) / 2000.0)) AS m0, 1 / (1 + exp(-(d.n_chars - 1500) / 1000.0)) AS m1, d.n_chars < 5000 AS valid
  FROM documents d JOIN labels l USING (doc_id) CROSS JOIN (VALUES ('post'), ('pre')) t(target))"""
VE = "ve AS (SELECT vec_id AS id, label, vec_id % 4 AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
LOSS = lambda p: f"(-y * ln(least(greatest({p}, 1e-15), 1 - 1e-15)) - (1 - y) * ln(1 - least(greatest({p}, 1e-15), 1 - 1e-15)))"


def whole(sql: str) -> str:
    """``count_if`` gives DuckDB's widest integer; as BIGINT it is what Spark gives."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 1, k + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:k], "CAST(", sql[k:end], " AS BIGINT)"]
        at = end
    return "".join([*out, sql[at:]])


def greedy_folds(name: str, source: str, k: int, seed: int) -> str:
    """CTEs of a recursive query: {name} has (p, user_id, size, fold) of groups that go, largest first, to the fold with the least."""
    least = "list_position(r.load, list_min(r.load))"
    return f"""{name}_g AS (SELECT user_id, size, row_number() OVER (ORDER BY size DESC, sha256('{seed}|' || user_id), user_id) AS p FROM ({source})),
{name}_r AS (SELECT CAST(0 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS user_id, CAST(0 AS BIGINT) AS size, 0 AS fold, CAST([{", ".join("0" * k)}] AS BIGINT[]) AS load
  UNION ALL SELECT g.p, g.user_id, g.size, CAST({least} AS INTEGER), list_transform(range(1, {k + 1}), lambda i: r.load[i] + CASE WHEN i = {least} THEN g.size ELSE 0 END) FROM {name}_r r JOIN {name}_g g ON g.p = r.p + 1),
{name} AS (SELECT p, user_id, size, fold FROM {name}_r WHERE p > 0)"""


def register(queries: dict, oracles: dict) -> Callable:
    """A decorator: puts a query, and its SQL if there is one, under the function's name."""

    def with_sql(sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = whole(sql)
            return f

        return put

    return with_sql
