"""Paths, URIs, request outcomes and content sniffing, in SQL expression text over native functions."""

from __future__ import annotations

#: Markers of glTF features that need work of their own.
MARKERS = {
    "splat": "KHR_gaussian_splatting",
    "draco": "KHR_draco_mesh_compression",
    "rtc": "CESIUM_RTC",
    "copyright": "copyright",
    "meshopt": "EXT_meshopt_compression",
    "basisu": "KHR_texture_basisu",
    "features": "EXT_mesh_features",
}


def normalized(path: str) -> str:
    """Archive paths: forward slashes, none in front."""
    return f"ltrim('/', replace({path}, '\\\\', '/'))"


def path_hash(path: str) -> str:
    return f"unhex(md5({normalized(path)}))"


def sort_key(hash_: str) -> str:
    """Binary whose order is that of the hash's two little-endian 64-bit halves."""
    byte = lambda k: f"substring({hash_}, {k}, 1)"
    return "concat(" + ", ".join(byte(k) for k in (*range(8, 0, -1), *range(16, 8, -1))) + ")"


def without_query(uri: str) -> str:
    return f"regexp_extract({uri}, '^[^?#]*', 0)"


def is_archive(spec: str) -> str:
    return f"endswith({without_query(spec)}, '.3tz')"


def directory(uri: str) -> str:
    """The path up to its last slash; null without one."""
    return f"nullif(regexp_extract({without_query(uri)}, '^.*/', 0), '')"


def rebased(uri: str, host: str) -> str:
    """A grafted subtree's URI seen from the host: relative ones get the host document's directory."""
    return f"if(startswith({uri}, '/') OR contains({uri}, '://') OR {directory(host)} is null, {uri}, concat({directory(host)}, {uri}))"


def has_parameter(uri: str, name: str) -> str:
    return f"(instr({uri}, '?') > 0 AND exists(split(substring({uri}, instr({uri}, '?') + 1), '&'), q -> startswith(q, '{name}=')))"


def session(uri: str) -> str:
    """The session token of a URI's query, without the fragment; null where there is none or an empty one."""
    query = f"element_at(split(substring({uri}, instr({uri}, '?') + 1), '#'), 1)"
    found = f"get(filter(split({query}, '&'), q -> startswith(q, 'session=')), 0)"
    return f"if(instr({uri}, '?') > 0, nullif(substring({found}, 9), ''), null)"


def appended(uri: str, name: str, value: str) -> str:
    """The URI with name=value at the end, unless its query has the name or the value is null."""
    return f"if({value} is null OR {has_parameter(uri, name)}, {uri}, concat({uri}, if(contains({uri}, '?'), '&', '?'), '{name}=', {value}))"


def site(url: str) -> str:
    """Scheme and host; the whole URL where no path follows."""
    return f"coalesce(nullif(regexp_extract({url}, '^(.*?://[^/]*)/', 1), ''), {url})"


def entry_url(root: str, uri: str, key: str, token: str) -> str:
    """The URL of a live source's entry: absolute or on the root's site, with key and session once each."""
    base = f"if(startswith({uri}, 'http://') OR startswith({uri}, 'https://'), {uri}, concat({site(root)}, '/', ltrim('/', {uri})))"
    return appended(f"({appended(f'({base})', 'key', key)})", "session", token)


def cache_key(kind: str, base: str, uri: str) -> str:
    """Source and entry without the source's query; null for local and live sources."""
    return f"if({kind} <> 'live' AND (startswith({base}, 'http://') OR startswith({base}, 'https://')), concat(rtrim('/', element_at(split({base}, '[?]'), 1)), '/', ltrim('/', {uri})), null)"


def joined(base: str, uri: str) -> str:
    return f"concat(rtrim('/', {base}), '/', ltrim('/', {uri}))"


def status_code(message: str) -> str:
    """The number behind the first 'status '; null without one that a status can be."""
    return f"if(try_cast(nullif(regexp_extract({message}, '(?s)^.*?status ([0-9]*)', 1), '') AS int) <= 65535, try_cast(nullif(regexp_extract({message}, '(?s)^.*?status ([0-9]*)', 1), '') AS int), null)"


def transient(kind: str, message: str) -> str:
    """Whether a failed request may be tried again: no status, or 5xx, 408, 429."""
    code = status_code(message)
    return f"({kind} = 'http' AND coalesce({code} BETWEEN 500 AND 599 OR {code} IN (408, 429), true))"


def content_range_total(value: str) -> str:
    return f"try_cast(nullif(regexp_extract({value}, '^\\\\s*bytes.*/\\\\s*([0-9]+)\\\\s*$', 1), '') AS bigint)"


def looks_like_tileset(text: str) -> str:
    return f"(NOT startswith({text}, 'glTF') AND startswith(ltrim(' \\t\\n\\r\\f', {text}), '{{') AND contains({text}, '\"geometricError\"') AND contains({text}, '\"root\"'))"


def marker(text: str, name: str) -> str:
    return f"contains({text}, '{MARKERS[name]}')"


def vanilla(text: str) -> str:
    """No marker: the content needs no rewriting."""
    return "NOT (" + " OR ".join(marker(text, m) for m in MARKERS) + ")"


def prepare_declines(text: str, on_planet: str) -> str:
    return f"({marker(text, 'draco')} OR {marker(text, 'splat')} OR (NOT {on_planet} AND {vanilla(text)}))"


def extract_declines(text: str, on_planet: str) -> str:
    """Whether neither preparing nor extracting can help."""
    cannot = " OR ".join(f"contains({text}, '\"{k}\"')" for k in ("images", "textures", "extensionsRequired"))
    return f"({prepare_declines(text, on_planet)} AND ({cannot} OR {marker(text, 'draco')} OR {marker(text, 'splat')}))"
