"""Column expressions over URLs, JSON payloads, durations and times; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST_OF_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATTERN_FORMAT = r"\A\*\.[a-zA-Z0-9-]+(\.[a-zA-Z]{2,})+\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_host(url: Column | str) -> Column:
    """The authority's host without port and user, its case kept; empty if the URL has none."""
    return F.regexp_extract(col(url), HOST_OF_URL, 1)


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def matches_pattern(fqdn: Column | str, pattern: Column | str, casefold: bool = False) -> Column:
    """Whether a host name lies below a pattern `*.suffix`, with at least one character before the suffix."""
    f, p = col(fqdn), col(pattern)
    if casefold:
        f, p = F.lower(f), F.lower(p)
    return F.coalesce(p.startswith("*.") & (F.length(f) > F.length(p) - 1) & F.endswith(f, F.substring(p, F.lit(2), F.length(p))), F.lit(False))


def valid_pattern(value: Column | str) -> Column:
    """Whether a value has the form `*.label.tld`; only the first label may hold digits."""
    return F.coalesce(col(value).rlike(PATTERN_FORMAT), F.lit(False))


def valid_ip(ip: Column | str) -> Column:
    """The address if it is IPv4 or IPv6 text, else null."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    four = rf"\A{octet}(\.{octet}){{3}}\z"
    # one "::" at most, groups of one to four hex digits, eight of them without it and at most seven with it
    six = r"\A(?=[0-9a-fA-F:]{2,39}\z)(?!.*::.*::)(?!.*:::)(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=.*::)(?!([0-9a-fA-F]{1,4}:+){7}[0-9a-fA-F]{1,4}\z)(::)?([0-9a-fA-F]{1,4}(::?|\z)){0,7})\z"
    return F.when(col(ip).rlike(four) | col(ip).rlike(six), col(ip))


def host_status(raw_ip: Column | str) -> Column:
    """alive if the observation names an address, valid or not, else unreachable."""
    return F.when(col(raw_ip).isNull(), "unreachable").otherwise("alive")


def json_value(document: Column | str) -> Column:
    return F.try_parse_json(col(document))


def _protocol(ports: Column, name: str) -> Column:
    return F.try_variant_get(json_value(ports), f"$.{name}", "map<string,variant>")


def open_ports(ports: Column | str, protocol: str = "tcp") -> Column:
    """Sorted port names of one protocol; empty for null, broken or other JSON."""
    return F.sort_array(F.coalesce(F.map_keys(_protocol(col(ports), protocol)), F.array().cast("array<string>")))


def has_open_port(ports: Column | str, port: int | str) -> Column:
    return F.array_contains(open_ports(ports), str(port))


def web_urls(ports: Column | str) -> Column:
    """URLs of TCP and then UDP ports, in the order of the port names; none if any entry of the document is malformed."""
    document = json_value(col(ports))
    every = []
    sound = F.lit(True)
    for name in ("tcp", "udp"):
        part = F.try_variant_get(document, f"$.{name}", "variant")
        entries = F.try_variant_get(document, f"$.{name}", "map<string,variant>")
        kind = F.schema_of_variant(part)
        sound = sound & (kind.isNull() | kind.startswith("OBJECT") | (kind == "VOID"))
        values = F.coalesce(F.transform(F.array_sort(F.map_entries(entries)["key"]), lambda k: F.element_at(entries, k)), F.array().cast("array<variant>"))
        web = F.transform(values, lambda x: F.try_variant_get(x, "$.web", "variant"))
        fine = F.forall(values, lambda x: F.schema_of_variant(x).startswith("OBJECT") | (F.schema_of_variant(x) == "VOID")) & F.forall(
            web, lambda w: w.isNull() | F.schema_of_variant(w).isin("STRING", "VOID")
        )
        sound = sound & F.coalesce(fine, F.lit(True))
        every.append(F.filter(F.transform(web, lambda w: F.try_variant_get(w, "$", "string")), lambda u: u.isNotNull()))
    return F.when(sound, F.concat(*every)).otherwise(F.array().cast("array<string>"))


def host_type(ports: Column | str) -> Column:
    """web if any port has a URL, else other if any port is open, else unknown."""
    n_open = F.size(open_ports(ports, "tcp")) + F.size(open_ports(ports, "udp"))
    return F.when(F.size(web_urls(ports)) > 0, "web").when(n_open > 0, "other").otherwise("unknown")


def first_hop(chain: Column | str, field: str) -> Column:
    return F.try_variant_get(json_value(chain), f"$[0].{field}", "string")


def status_code(chain: Column | str) -> Column:
    """Status code of the first hop; null where it is missing or no number."""
    return first_hop(chain, "status_code").try_cast("int")


def status_class(chain: Column | str) -> Column:
    """1 to 5 for 1xx to 5xx."""
    return F.floor(status_code(chain) / 100).cast("int")


def status_bucket(code: Column | str) -> Column:
    c = col(code)
    return F.when(c.between(200, 299), "2xx").when(c.between(300, 399), "3xx").when(c.between(400, 499), "4xx").when(c >= 500, "5xx").otherwise("other")


def chain_info(chain: Column | str) -> Column:
    """struct(status_code, title) of the first hop, 0 and "" where missing."""
    return F.struct(F.coalesce(status_code(chain), F.lit(0)).alias("status_code"), F.coalesce(first_hop(chain, "title"), F.lit("")).alias("title"))


def hops(chain: Column | str) -> Column:
    return F.try_variant_get(json_value(chain), "$", "array<struct<url:string,title:string,status_code:int,response_size:bigint>>")


def technologies(document: Column | str) -> Column:
    """array<struct<name,version,category>>; empty for null, broken or other JSON."""
    kind = "array<struct<name:string,version:string,category:string>>"
    return F.coalesce(F.try_variant_get(json_value(document), "$", kind), F.array().cast(kind))


def sound_technologies(document: Column | str) -> Column:
    """technologies of a document whose entries are all objects with text fields; none of any other."""
    entries = F.try_variant_get(json_value(document), "$", "array<variant>")

    def sound(entry: Column) -> Column:
        fine = F.coalesce(F.schema_of_variant(entry).startswith("OBJECT"), F.lit(False))
        for field in ("name", "version", "category"):
            kind = F.schema_of_variant(F.try_variant_get(entry, f"$.{field}", "variant"))
            fine = fine & (kind.isNull() | kind.isin("STRING", "VOID"))
        return fine

    found = technologies(document)
    return F.when(F.coalesce(F.forall(entries, sound), F.lit(True)), found).otherwise(F.slice(found, 1, 0))


def technology_names(document: Column | str) -> Column:
    """`Name Version`, or the name alone where the version is empty."""
    return F.transform(sound_technologies(document), lambda t: F.concat_ws(" ", t["name"], F.nullif(t["version"], F.lit(""))))


def has_technology(document: Column | str, text: str, like: bool = False) -> Column:
    """Whether some technology's name contains text, case ignored; like: `%` and `_` in text are wild."""
    wanted = text.lower()
    if like:
        wanted = wanted.replace("\\", "\\\\")
        return F.exists(technologies(document), lambda t: F.lower(t["name"]).like(f"%{wanted}%"))
    return F.exists(technologies(document), lambda t: F.contains(F.lower(t["name"]), F.lit(wanted)))


def top_technologies(document: Column | str, n: int = 5) -> Column:
    """struct(names, more): the first n names and how many others there are."""
    names = technology_names(document)
    return F.struct(F.slice(names, 1, n).alias("names"), F.greatest(F.size(names) - n, F.lit(0)).alias("more"))


def favicon(metadata: Column | str) -> Column:
    return F.coalesce(F.try_variant_get(json_value(metadata), "$.favicon", "string"), F.lit(""))


def external_host_count(document: Column | str) -> Column:
    return F.coalesce(F.size(F.try_variant_get(json_value(document), "$", "array<string>")), F.lit(0))


def chain_text(chain: Column | str) -> Column:
    """Status codes joined by arrows, as 301→200."""
    return F.array_join(F.transform(hops(chain), lambda h: h["status_code"].cast("string")), "→")


def size_text(chain: Column | str, ties_to_even: bool = False) -> Column:
    return F.array_join(F.transform(hops(chain), lambda h: byte_size(h["response_size"], ties_to_even)), "→")


def byte_size(size: Column | str, ties_to_even: bool = False) -> Column:
    """512B, 2.5KB or 3.5MB; what lies in the middle of two tenths is rounded up, as toFixed does, or to the even one, as printf does."""
    s = col(size)
    tenth = (lambda x: F.bround(x, 1)) if ties_to_even else (lambda x: x)
    return (
        F.when(s < 1024, F.format_string("%dB", s))
        .when(s < 1024 * 1024, F.format_string("%.1fKB", tenth(s / 1024)))
        .when(s.isNotNull(), F.format_string("%.1fMB", tenth(s / (1024 * 1024))))
    )


def duration_mmss(seconds: Column | str) -> Column:
    """14m32s; minutes have no upper limit."""
    s = col(seconds).cast("long")
    return F.format_string("%dm%02ds", F.floor(s / 60), s % 60)


def duration_text(seconds: Column | str) -> Column:
    """32s, 14m 32s or 2h 5m."""
    s = col(seconds).cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.format_string("%ds", s)).when(minutes < 60, F.format_string("%dm %ds", minutes, s % 60)).when(s.isNotNull(), F.format_string("%dh %dm", hours, minutes % 60))


def time_ago(at: Column | str, as_of: Column) -> Column:
    """just now, 5m ago, 3h ago or 2d ago; null for a null time."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(col(at).cast("timestamp"))
    return (
        F.when(s.isNull(), None)
        .when(s < 60, "just now")
        .when(s < 3600, F.format_string("%dm ago", F.floor(s / 60)))
        .when(s < 86400, F.format_string("%dh ago", F.floor(s / 3600)))
        .otherwise(F.format_string("%dd ago", F.floor(s / 86400)))
    )


def rfc3339(at: Column | str) -> Column:
    return F.date_format(col(at).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def day_label(at: Column | str) -> Column:
    return F.date_format(col(at).cast("timestamp"), "dd MMM yyyy, HH:mm")


def id_label(value: Column | str, key: Column | str) -> Column:
    """The label, or the first eight characters of the id."""
    return F.coalesce(col(value), F.substring(col(key), 1, 8))


def stable_id(*natural_key: Column | str) -> Column:
    """A UUID-shaped id that depends on the natural key alone."""
    digest = F.md5(F.concat_ws("\u0001", *[col(c).cast("string") for c in natural_key]))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def page_number(value: Column | str) -> Column:
    n = col(value).cast("string").try_cast("int")
    return F.least(F.when(n >= 1, n).otherwise(1), F.lit(10000))


def page_size(value: Column | str) -> Column:
    n = col(value).cast("string").try_cast("int")
    return F.least(F.when(n >= 1, n).otherwise(50), F.lit(200))


def json_with_nulls(*columns: Column | str) -> Column:
    """A JSON object that keeps missing values as null."""
    return F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})


def has_dns_records(dns: Column | str) -> Column:
    """Whether a DNS document names a record of any kind."""
    kinds = F.try_variant_get(json_value(dns), "$", "map<string,array<string>>")
    return F.coalesce(F.exists(F.map_values(kinds), lambda v: F.size(v) > 0), F.lit(False))
