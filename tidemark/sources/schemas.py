"""Schemas and allowed values of the inventory's tables and feeds."""

from __future__ import annotations

HOST_STATUS = ("alive", "dead", "unreachable")
HOST_TYPE = ("web", "other", "unknown")
SCAN_MODE = ("normal", "intensive")
JOB_STATUS = ("pending", "running", "completed", "failed", "timeout")
QUEUE_STATUS = ("pending", "processing", "done", "failed")
QUEUE_SOURCE = ("discovery", "certificate", "revalidation", "manual")

PATTERNS = "id string, value string, active boolean, last_discovery_at timestamp, last_revalidated_at timestamp, created_at timestamp"
HOSTS = (
    "id string, pattern_id string, fqdn string, ip string, cdn string, status string, type string, dns string, ports string, "
    "last_seen_at timestamp, created_at timestamp, updated_at timestamp"
)
SERVICES = (
    "id string, host_id string, url string, chain string, technologies string, cookies string, metadata string, external_hosts string, "
    "scanned_at timestamp, created_at timestamp, updated_at timestamp"
)
JOBS = "id string, pattern_id string, mode string, status string, external_id string, started_at timestamp, completed_at timestamp, created_at timestamp"
QUEUE = "id string, host_id string, url string, source string, status string, retry_count int, created_at timestamp, updated_at timestamp"

JOB_MARKS = "job_id string, last struct<seq:bigint,status:string>, began struct<seq:bigint,at:timestamp>, ended struct<seq:bigint,at:timestamp>"
BUSY_KEYS = "key long, busy boolean"
PATTERN_COUNTS = "id string, total long, alive long, dead long, unreachable long, web long"
LOOP_ROWS = "id string, key long, opened long, status string, retry_count int, created_at timestamp, updated_at timestamp, ready boolean"

DISCOVERY_FEED = "job_id string, host struct<fqdn:string,ip:string,cdn:string,dns:string,ports:string>"
CERTIFICATE_FEED = "url string"
JOB_STATUS_FEED = "seq long, job_id string, status string, at timestamp"
SCAN_RESULT_FEED = "seq long, queue_id string, http_status int, body string, at timestamp"

HOP = "array<struct<url:string,title:string,status_code:int,response_size:bigint>>"
TECHNOLOGY = "array<struct<name:string,version:string,category:string>>"


def one_of(value: str | None, allowed: tuple[str, ...], name: str) -> str | None:
    """The value, if it is None or allowed; a clear error otherwise."""
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value
