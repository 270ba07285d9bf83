"""DuckDB SQL of the derived tables, shared by the queries' SQL."""

from __future__ import annotations

from ..sources.fixtures import PATTERN_ROWS

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


def uuid_of(text: str) -> str:
    return rf"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


_PATTERNS = ", ".join(f"('{i}', '{v}', {str(a).lower()})" for i, v, a in PATTERN_ROWS)

#: Derived tables by name, each with the names of those it reads.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "pats": ((), f"SELECT id, value, active, TIMESTAMP '2024-01-01' + to_minutes(id::INTEGER) AS created_at FROM (VALUES {_PATTERNS}) t(id, value, active)"),
    "track": ((), "SELECT s_suppkey::VARCHAR AS id, '*.s' || s_suppkey || '.example.com' AS value, s_acctbal > 0 AS active, TIMESTAMP '2024-01-01' + to_minutes((s_suppkey % 997)::INTEGER) AS created_at FROM supplier"),
    "cust": ((), "SELECT c_custkey AS seq, 'c' || c_custkey || '.s' || (c_custkey % 150 + 1) || '.example.com' AS fqdn FROM customer"),
    "obs": (
        (),
        f"""SELECT page_id AS seq, url, {HOST} AS fqdn, CASE WHEN page_id % 10 <> 0 THEN '10.0.0.' || (page_id % 250) END AS ip,
          CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'other' ELSE 'web' END AS port_kind,
          CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN '22' ELSE '443' END AS port,
          TIMESTAMP '2024-01-01' + to_minutes(page_id::INTEGER) AS observed_at FROM pages""",
    ),
    "matched": (
        ("obs", "pats"),
        """SELECT fqdn, arg_min(p.id, struct_pack(c := p.created_at, i := p.id)) AS pattern_id FROM (SELECT DISTINCT fqdn FROM obs WHERE fqdn <> '') o
          JOIN pats p ON p.active AND suffix(o.fqdn, substr(p.value, 2)) AND length(o.fqdn) > length(p.value) - 1 GROUP BY fqdn""",
    ),
    "host": (
        ("obs", "matched"),
        f"""SELECT fqdn, {uuid_of('fqdn')} AS id, pattern_id, l.ip AS ip, CASE WHEN l.ip IS NULL THEN 'unreachable' ELSE 'alive' END AS status,
          coalesce(l.kind, 'unknown') AS type, l.port AS port, CASE WHEN l.ip IS NOT NULL THEN l.at END AS last_seen_at, created_at, last_seq
          FROM (SELECT fqdn, arg_max(struct_pack(ip := ip, kind := port_kind, port := port, at := observed_at), seq) AS l, min(observed_at) AS created_at, max(seq) AS last_seq FROM obs GROUP BY fqdn)
          LEFT JOIN matched USING (fqdn)""",
    ),
    "svc": (
        (),
        f"""SELECT page_id::VARCHAR AS id, {HOST} AS fqdn, url, page_id, length(html) AS size,
          CASE page_id % 8 WHEN 3 THEN 301 WHEN 4 THEN 302 WHEN 5 THEN 404 WHEN 6 THEN 403 WHEN 7 THEN 500 ELSE 200 END AS code,
          CASE WHEN page_id % 8 IN (3, 4) THEN '' ELSE 'Page ' || page_id END AS title, page_id % 8 IN (3, 4) AS two,
          CASE page_id % 4 WHEN 0 THEN ['Kestrel', 'Elixir 1.17'] WHEN 1 THEN ['Svelte 5'] ELSE [] END AS tech,
          CASE WHEN page_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(page_id::INTEGER) END AS scanned_at,
          TIMESTAMP '2024-01-01' + to_minutes(page_id::INTEGER) AS created_at FROM pages""",
    ),
    "small": (
        (),
        f"""SELECT {uuid_of('fqdn')} AS id, fqdn, (n % 4 + 1)::VARCHAR AS pattern_id, CASE WHEN n % 3 = 0 THEN 'dead' ELSE 'alive' END AS status,
          TIMESTAMP '2024-01-01' + to_minutes(n::INTEGER) AS created_at, TIMESTAMP '2024-01-01' + to_minutes((n + 5)::INTEGER) AS updated_at
          FROM (SELECT {HOST} AS fqdn, min(page_id) AS n FROM pages GROUP BY 1)""",
    ),
    "job": (
        (),
        """SELECT id, pattern_id, mode, status, external_id, CASE WHEN status <> 'pending' THEN created_at + to_minutes(1) END AS started_at,
          CASE WHEN status NOT IN ('pending', 'running') THEN created_at + to_minutes(1) + to_seconds(n % 7200) END AS completed_at, created_at
          FROM (SELECT o_orderkey AS n, o_orderkey::VARCHAR AS id, (o_custkey % 4 + 1)::VARCHAR AS pattern_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'intensive' ELSE 'normal' END AS mode,
            CASE WHEN o_orderkey % 500 = 0 THEN 'pending' WHEN o_orderkey % 500 = 1 THEN 'running' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'timeout' ELSE 'completed' END AS status,
            CASE WHEN o_orderkey % 3 <> 0 THEN 'ext-' || o_orderkey END AS external_id, TIMESTAMP '2024-01-01' + to_minutes((o_orderkey % 250)::INTEGER) AS created_at FROM orders)""",
    ),
    "qev": (
        (),
        """SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fail' END AS kind, ts AS moment
          FROM events WHERE event_type <> 'click'""",
    ),
    "qseg": (("qev",), "SELECT *, coalesce(sum((kind IN ('ok', 'fail'))::INT) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM qev"),
    "qadm": (
        ("qseg",),
        """SELECT *, kind = 'enqueue' AND coalesce(sum((kind IN ('enqueue', 'start'))::INT) OVER (PARTITION BY key, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS admitted FROM qseg""",
    ),
    "qera": (("qadm",), "SELECT *, sum(admitted::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS era FROM qadm"),
    "qrow": (
        ("qera",),
        """SELECT key, era::BIGINT AS row, arg_max(moved, seq) AS status, count_if(kind = 'fail')::INTEGER AS retry_count, min(moment) AS created_at, max(moment) AS updated_at
          FROM (SELECT *, CASE WHEN admitted THEN 'pending' WHEN kind = 'start' THEN 'processing' WHEN kind = 'ok' THEN 'done' WHEN kind = 'fail' THEN 'failed' END AS moved FROM qera WHERE era > 0)
          WHERE moved IS NOT NULL GROUP BY key, era""",
    ),
    "qnum": (("qev",), "SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, seq) AS n FROM qev"),
    "qturn": (  # one event of each key a step; st and since are the row's state once a stale one is recovered
        ("qnum",),
        """SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS opened, 'none' AS status, 0 AS retry_count, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM qnum
          UNION ALL SELECT key, n, CASE WHEN opens THEN seq ELSE opened END, CASE WHEN opens THEN 'pending' WHEN starts THEN 'processing' WHEN ends AND kind = 'ok' THEN 'done' WHEN ends THEN 'failed' ELSE st END,
            CASE WHEN opens THEN 0 ELSE retry_count + (ends AND kind = 'fail')::INT END, CASE WHEN opens THEN moment ELSE created_at END, CASE WHEN opens OR starts OR ends THEN moment ELSE since END
          FROM (SELECT *, kind = 'enqueue' AND st IN ('none', 'done', 'failed') AS opens, kind = 'start' AND (st = 'pending' OR st = 'failed' AND retry_count < 3) AS starts,
              kind IN ('ok', 'fail') AND st IN ('pending', 'processing') AS ends
            FROM (SELECT e.key, e.n, e.seq, e.kind, e.moment, t.opened, t.retry_count, t.created_at,
                CASE WHEN t.status = 'processing' AND e.moment > t.updated_at + INTERVAL 2 MINUTE THEN 'pending' ELSE t.status END AS st,
                CASE WHEN t.status = 'processing' AND e.moment > t.updated_at + INTERVAL 2 MINUTE THEN t.updated_at + INTERVAL 2 MINUTE ELSE t.updated_at END AS since
              FROM qturn t JOIN qnum e ON e.key = t.key AND e.n = t.n + 1))""",
    ),
    "qloop": (
        ("qturn",),
        """SELECT key, opened, retry_count, created_at, CASE WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN stale THEN updated_at + INTERVAL 2 MINUTE ELSE updated_at END AS updated_at
          FROM (SELECT *, status = 'processing' AND (SELECT max(moment) FROM qnum) > updated_at + INTERVAL 2 MINUTE AS stale FROM (
            SELECT *, row_number() OVER (PARTITION BY key, opened ORDER BY n DESC) AS back FROM qturn WHERE opened IS NOT NULL) WHERE back = 1)""",
    ),
    "lev": (
        (),
        """SELECT user_id AS key, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'dns_ok' WHEN event_id % 11 = 0 THEN 'ok' WHEN event_type = 'purchase' THEN 'alive' WHEN event_type = 'click' THEN 'unreachable'
            WHEN event_type = 'signup' THEN 'certificate' WHEN event_type = 'error' THEN 'fail' ELSE 'dns_fail' END AS kind,
          ['web', 'other', 'unknown'][(floor(value)::BIGINT % 3 + 1)] AS type, event_id % 2 = 0 AS answered, CASE WHEN event_id % 2 = 0 THEN 'certificate' ELSE 'discovery' END AS source FROM events""",
    ),
    "lty": (
        ("lev",),
        """SELECT * REPLACE (coalesce(last_value(CASE WHEN kind IN ('alive', 'unreachable') THEN type END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING), 'unknown') AS type) FROM lev""",
    ),
    "lset": (
        ("lty",),
        """SELECT *, CASE WHEN kind IN ('alive', 'unreachable') THEN kind WHEN kind = 'ok' THEN 'alive' WHEN kind = 'dns_ok' AND NOT (type = 'other' AND NOT answered) THEN 'alive' END AS sets,
          (kind IN ('fail', 'dns_fail') OR (kind = 'dns_ok' AND type = 'other' AND NOT answered))::INT AS kills FROM lty""",
    ),
    "lseg": (("lset",), "SELECT *, sum((sets IS NOT NULL)::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment FROM lset"),
    "lst": (
        ("lseg",),
        """SELECT *, CASE WHEN base IS NULL THEN 'unreachable' WHEN base = 'alive' AND killed = 1 THEN 'dead' ELSE base END AS status FROM (
          SELECT *, max(sets) OVER w AS base, max(kills) OVER w AS killed FROM lseg WINDOW w AS (PARTITION BY key, segment ORDER BY seq ROWS UNBOUNDED PRECEDING))""",
    ),
    "life": (("lst",), "SELECT *, coalesce(lag(status) OVER (PARTITION BY key ORDER BY seq), 'unreachable') AS before FROM lst"),
    "reval": (
        ("host",),
        """SELECT *, CASE WHEN NOT dns_ok OR (type = 'other' AND NOT (port = '22' AND length(fqdn) % 2 = 1)) THEN CASE WHEN status = 'alive' THEN 'dead' ELSE status END ELSE 'alive' END AS new_status
          FROM (SELECT *, length(fqdn) % 4 <> 0 AS dns_ok FROM host)""",
    ),
    "jev": (
        (),
        "SELECT event_id AS seq, user_id::VARCHAR AS job_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'timeout' ELSE 'pending' END AS status, ts AS moment FROM events",
    ),
    "jst": (
        ("jev",),
        """SELECT job_id, arg_max(status, seq) AS status, arg_max(moment, seq) FILTER (WHERE status = 'running') AS started_at, arg_max(moment, seq) FILTER (WHERE status IN ('completed', 'failed', 'timeout')) AS completed_at
          FROM jev WHERE status <> 'pending' GROUP BY job_id""",
    ),
    "stats": (
        ("job", "small", "svc"),
        """SELECT j.id AS job_id, coalesce(h.n, 0)::BIGINT AS new_hosts, coalesce(h.d, 0)::BIGINT AS newly_dead, coalesce(s.n, 0)::BIGINT AS new_services FROM job j
          LEFT JOIN (SELECT x.pattern_id, x.started_at, count_if(s.created_at >= x.started_at) AS n, count_if(s.status = 'dead' AND s.updated_at >= x.started_at) AS d
            FROM (SELECT DISTINCT pattern_id, started_at FROM job WHERE started_at IS NOT NULL) x JOIN small s USING (pattern_id) GROUP BY ALL) h ON h.pattern_id = j.pattern_id AND h.started_at = j.started_at
          LEFT JOIN (SELECT x.pattern_id, x.started_at, count_if(v.created_at >= x.started_at) AS n
            FROM (SELECT DISTINCT pattern_id, started_at FROM job WHERE started_at IS NOT NULL) x JOIN small s USING (pattern_id) JOIN svc v ON v.fqdn = s.fqdn GROUP BY ALL) s ON s.pattern_id = j.pattern_id AND s.started_at = j.started_at""",
    ),
}


def sql(body: str, *parts: str) -> str:
    """A query over derived tables, with all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in PARTS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in parts:
        need(name)
    head = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in order)
    return f"WITH RECURSIVE {head}\n{body}" if order else body
