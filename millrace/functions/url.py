"""URL functions: canonical form, host, path segments, resolution against a base.

``canonical_url`` follows the WHATWG URL model. Plain http(s) URLs (nearly all feed links) are handled by
JVM expressions inside whole-stage codegen; only the rest goes, Arrow-batched, through a Python parser.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, quote_plus, unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.bind import let

# --- fixed values: query parameters that only track -------------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = [
    "fbclid", "gclid", "msclkid", "yclid", "dclid", "_ga", "ref", "ref_src", "ref_url", "referrer", "referer",
    "src", "source", "feature", "feed_id", "feed", "rss", "share", "shared", "fromrss", "from_rss", "from",
    "mc_cid", "mc_eid", "mkt_tok", "hsCtaTracking", "_hsenc", "_hsmi", "campaign_id", "campaign", "medium",
    "guccounter", "guce_referrer", "guce_referrer_sig",
]
# --- end of fixed values ----------------------------------------------------------------------------
# A name is compared in lower case, so the one listed with capitals never matches. That is the required result.

#: White space as ECMAScript's trim() knows it.
WHITE_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

_DEFAULT_PORT = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_PATH_SAFE = "!$&'()*+,-./:;=@_~%|[]\\^"
_HOST_BAD = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_PLAIN = (
    r"^(?![^?#]*/\.)(?![^?#]*[xX][nN]--)[hH][tT][tT][pP][sS]?://(?:[A-Za-z0-9-]+\.)*[A-Za-z][A-Za-z0-9-]*(?::[1-9][0-9]{0,3})?"
    r"(?:/[A-Za-z0-9/._~!$&'()*+,;=:@-]*)?(?:\?(?:&|[A-Za-z0-9*._-]+(?:=[A-Za-z0-9*._-]*)?(?=&|#|\z))*)?(?:#.*)?\z"
)


def _ipv4(host: str) -> str | None:
    """Dotted form of a host that ends in a number; None where it is no valid address; the host itself otherwise."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return host
    try:
        nums = [int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    if len(nums) > 4 or any(n > 255 for n in nums[:-1]) or nums[-1] >= 256 ** (5 - len(nums)):
        return None
    return str(ipaddress.IPv4Address(nums[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(nums[:-1]))))


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        if not raw.endswith("]"):
            return None
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
        except ValueError:
            return None
    name = unquote_to_bytes(raw).decode("utf-8", "replace").lower()
    if not name.isascii():
        try:
            name = name.encode("idna").decode()
        except UnicodeError:
            return None
    if not name or _HOST_BAD.search(name):
        return None
    return _ipv4(name)


def _path(raw: str) -> str:
    out: list[str] = []
    parts = raw.replace("\\", "/").split("/")
    for i, seg in enumerate(parts[1:], 1):
        dots = re.sub("%2e", ".", seg, flags=re.I)
        if dots == "..":
            out = out[:-1]
            if i == len(parts) - 1:
                out.append("")
        elif dots == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(quote(seg, safe=_PATH_SAFE))
    return "/" + "/".join(out)


def _kept_query(raw: str) -> str:
    keep = [(k, v) for k, v in parse_qsl(raw, keep_blank_values=True, separator="&", max_num_fields=None) if not is_tracking(k)]
    keep.sort(key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    form = lambda s: quote_plus(s, safe="*-._").replace("~", "%7E")
    return "&".join(f"{form(k)}={form(v)}" for k, v in keep)


def is_tracking(name: str) -> bool:
    low = name.lower()
    return low in _TRACKING or low.startswith(TRACKING_PREFIX)


_TRACKING = frozenset(TRACKING_PARAMS)


def canonicalize(text: str) -> str:
    """Reference form of :func:`canonical_url` for one string; what is no URL comes back trimmed."""
    text = text.strip(WHITE_SPACE)
    url = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)\Z", url, re.S)
    if not m:
        return text
    scheme, rest = m[1].lower(), m[2].partition("#")[0]
    rest, asked, query = rest.partition("?")
    if scheme in _DEFAULT_PORT and scheme != "file":
        rest = rest.replace("\\", "/").lstrip("/")
        authority, slash, path = rest.partition("/")
        found = re.fullmatch(r"(.*?)(?::([0-9]*))?", authority.rpartition("@")[2], re.S)
        host, port = _host(found[1]), int(found[2]) if found[2] else None
        if host is None or (port or 0) > 65535:
            return text
        path = _path(slash + path) if slash else "/"
        if len(path) > 1 and path.endswith("/"):
            path = path.rstrip("/") or "/"
        head = f"{scheme}://{host}" + (f":{port}" if port is not None and port != _DEFAULT_PORT[scheme] else "") + path
    elif rest.startswith("/"):
        authority, path = ("", rest)
        if rest.startswith("//"):
            authority, slash, path = rest[2:].partition("/")
            path = slash + path
        path = _path(path) if path else ""
        head = f"{scheme}:" + ("//" + authority.rpartition("@")[2] if rest.startswith("//") else "") + (path.rstrip("/") if len(path) > 1 else path)
    else:
        head = f"{scheme}:" + quote(rest, safe=_PATH_SAFE + " \"<>`{}#?")
    kept = _kept_query(query) if asked else ""
    return head + ("?" + kept if kept else "")


@F.arrow_udf(StringType())
def _canonical_rest(urls: pa.Array) -> pa.Array:
    return pa.array([None if u is None else canonicalize(u) for u in urls.to_pylist()], pa.string())


def trim_white(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def canonical_url(url: Column) -> Column:
    """Canonical URL: lower-case scheme and host, no user, default port, fragment, tracking parameters or
    trailing slashes, parameters sorted by name (stable). Null stays null; what is no URL is only trimmed."""

    def kept_form(s: Column) -> Column:
        base = F.substring_index(s, "#", 1)
        return let(F.substring_index(base, "?", 1), lambda main: assembled(main, F.substr(base, F.length(main) + 2)))

    def assembled(main: Column, query: Column) -> Column:
        first, raw_host = F.split_part(main, F.lit("/"), F.lit(1)), F.split_part(main, F.lit("/"), F.lit(3))
        scheme, host = F.lower(first), F.lower(raw_host)
        path = F.rtrim(F.substr(main, F.length(first) + F.length(raw_host) + 3), F.lit("/"))
        tail = F.when(query == "", F.lit("")).otherwise(let(wanted_pairs(query), joined))
        return F.concat(scheme, F.lit("//"), _without_default_port(scheme, host), F.when(path == "", F.lit("/")).otherwise(path), tail)

    plain = url.rlike(_PLAIN)
    return F.coalesce(F.when(plain, kept_form(url)), _canonical_rest(F.when(~plain, _bare(url))))


def wanted_pairs(query: Column) -> Column:
    """The name=value pairs of a query that don't track, by name and then as they come."""

    def named(p: Column, i: Column) -> Column:
        return F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))

    def wanted(x: Column) -> Column:
        return let(F.lower(x["k"]), lambda low: (x["p"] != "") & ~low.startswith(TRACKING_PREFIX) & ~low.isin(TRACKING_PARAMS))

    return F.array_sort(F.filter(F.transform(F.split(query, "&"), named), wanted))


def joined(pairs: Column) -> Column:
    whole = F.transform(pairs, lambda x: F.when(x["p"].contains("="), x["p"]).otherwise(F.concat(x["p"], F.lit("="))))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(whole, "&"))).otherwise(F.lit(""))


def _without_default_port(scheme: Column, host: Column) -> Column:
    http = (scheme == "http:") & host.endswith(":80")
    https = (scheme == "https:") & host.endswith(":443")
    return F.when(http | https, F.substring_index(host, ":", 1)).otherwise(host)


def _bare(url: Column) -> Column:
    return F.translate(trim_white(url), "\t\n\r", "")


def domain(url: Column) -> Column:
    """Host in lower case, empty where there is none."""
    return F.coalesce(F.lower(F.try_parse_url(_bare(url), F.lit("HOST"))), F.lit(""))


def path_segments(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(_bare(url), F.lit("PATH")), F.lit(""))
    return F.filter(F.split(F.lower(path), "/"), lambda x: x != "")


def url_hash(canonical: Column) -> Column:
    return F.sha1(canonical)


@F.arrow_udf(StringType())
def _join_url(raw: pa.Array, base: pa.Array) -> pa.Array:
    def one(r: str | None, b: str | None) -> str | None:
        if r is None or not r.strip():
            return None
        try:
            full = urljoin(b or "", r.strip())
        except ValueError:
            return None
        return full if re.match(r"https?://", full, re.I) else None

    return pa.array([one(r, b) for r, b in zip(raw.to_pylist(), base.to_pylist())], pa.string())


def resolve_url(raw: Column, base: Column) -> Column:
    """Absolute http(s) form of a possibly relative URL; null for other schemes and for empty input."""
    return _join_url(raw, base)
