"""URL expressions: validation, comparison keys, parts, types and pagination."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import W, col, strip, text

# Schemes, limits, parameter names and file types.
MAX_DATA_URL_BYTES = 2 * 1024 * 1024
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid")
PAGE_KEYS, OFFSET_KEYS = ("page", "p", "pg"), ("start", "offset")
TYPE_GROUPS = {"pdf": "PDF", "zip": "ZIP", "csv": "CSV", "xls": "XLS/XLSX", "xlsx": "XLS/XLSX", "doc": "DOC/DOCX", "docx": "DOC/DOCX", "txt": "TXT", "json": "JSON", "xml": "XML", "jpg": "Images", "jpeg": "Images", "png": "Images", "webp": "Images", "gif": "Images", "svg": "Images"}

_ABSOLUTE = r"(?i)^[a-z][a-z0-9+.-]*:"
_WEB = r"(?i)^(https?)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def canonical(url: str, base: str | None = None, drop_fragment: bool = False) -> str | None:
    """An absolute URL in canonical form, or None. Host and scheme in lower case, default port dropped, empty path as /."""
    try:
        s = urljoin(base, url) if base else url
        u = urlsplit(s)
        if not u.scheme or (u.scheme in DEFAULT_PORTS and not u.hostname):
            return None
        if u.scheme not in DEFAULT_PORTS:
            return urlunsplit((u.scheme, u.netloc, u.path, u.query, "" if drop_fragment else u.fragment))
        host = (u.username or "") + (f":{u.password}" if u.password else "") + ("@" if u.username else "") + u.hostname
        if u.port is not None and str(u.port) != DEFAULT_PORTS[u.scheme]:
            host += f":{u.port}"
        return urlunsplit((u.scheme, host, u.path.replace(" ", "%20") or "/", u.query.replace(" ", "%20"), "" if drop_fragment else u.fragment))
    except ValueError:
        return None


def _mapped(c: Column, fn) -> Column:
    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    trimmed = strip(c)
    return F.when(trimmed == "", trimmed).otherwise(F.coalesce(each(trimmed), c))


def normalize(c, base: str | None = None, drop_fragment: bool = False) -> Column:
    return _mapped(col(c), lambda u: canonical(u, base, drop_fragment))


def untracked(url: str, base: str | None = None) -> str | None:
    if (u := canonical(url, base)) is None:
        return None
    p = urlsplit(u)
    if not p.query:
        return u
    return urlunsplit((p.scheme, p.netloc, p.path, urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k not in TRACKING]), p.fragment))


def remove_tracking(c, base: str | None = None) -> Column:
    return _mapped(col(c), lambda u: untracked(u, base))


def part(c, which: str = "domain") -> Column:
    """domain (without www.), hostname, origin, path or query of an absolute web URL; other values unchanged."""
    c = col(c)
    s = strip(c)
    authority = F.regexp_replace(F.lower(F.regexp_extract(s, _WEB, 2)), "^[^@]*@", "")
    scheme, host = F.lower(F.regexp_extract(s, _WEB, 1)), F.regexp_replace(authority, r":\d*$", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(s, _WEB, 3)
    found = {"hostname": host, "origin": F.concat(scheme, F.lit("://"), host, shown), "path": F.when(path == "", "/").otherwise(path), "query": F.regexp_replace(F.regexp_extract(s, _WEB, 4), r"^\?", "")}
    return F.when(s.rlike(_WEB), found.get(which, F.regexp_replace(host, r"^www\.", ""))).otherwise(F.when(s == "", s).otherwise(c))


def validate(c) -> Column:
    """struct(ok, scheme, reason) of a download address."""
    s = strip(text(c))
    reason = (
        F.when(s == "", "empty")
        .when(s.rlike("(?i)^blob:"), "unsupported-blob")
        .when(s.rlike("(?i)^data:") & ~s.rlike(r"(?i)^data:[a-z0-9.+-]+/[a-z0-9.+-]+;base64,"), "unsupported-data-url")
        .when(s.rlike("(?i)^data:") & (F.length(s) * 0.75 > MAX_DATA_URL_BYTES), "data-url-too-large")
        .when(s.rlike("(?i)^data:"), F.lit(None))
        .when(~s.rlike(_ABSOLUTE) | (s.rlike("(?i)^https?:") & ~s.rlike(r"(?i)^https?:/*[^/?#\s]")), "invalid-url")
        .when(~s.rlike("(?i)^https?:"), "disallowed-scheme")
    )
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), scheme).alias("scheme"), reason.alias("reason"))


def dedup_key(c) -> Column:
    """The URL without its fragment, host in lower case."""
    bare = F.regexp_replace(col(c), "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.when(head == "", bare).otherwise(F.concat(F.lower(head), F.when(F.length(bare) == F.length(head), "/").otherwise(""), F.substr(bare, F.length(head) + 1)))


def extension(c) -> Column:
    """The file ending of a URL's path in lower case, or null."""
    s = col(c)
    data = F.replace(F.lower(F.regexp_extract(s, r"(?i)^data:[a-z0-9.+-]+/([a-z0-9.+-]+);base64,", 1)), F.lit("jpeg"), F.lit("jpg"))
    path = F.regexp_extract(s, _WEB, 3)
    return F.nullif(F.when(s.rlike("(?i)^data:"), data).otherwise(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))), F.lit(""))


def type_group(c) -> Column:
    table = F.create_map(*(F.lit(v) for pair in TYPE_GROUPS.items() for v in pair))
    return F.coalesce(F.try_element_at(table, extension(c)), F.lit("Other"))


def origin_pattern(c) -> Column:
    """scheme://host/* of a web URL, or null."""
    s = col(c)
    return F.when(s.rlike(_WEB), F.concat(F.lower(F.regexp_extract(s, _WEB, 1)), F.lit("://"), F.lower(F.regexp_extract(s, _WEB, 2)), F.lit("/*")))


def pagination(c) -> Column:
    """struct(found, kind, key, style, start, step, confidence): which page a URL names."""
    s = col(c)
    kinds = "struct<found:boolean,kind:string,key:string,style:string,start:long,step:int,confidence:string>"

    def answer(kind, key, style, start, step, confidence):
        return F.struct(F.lit(True).alias("found"), F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.lit(style).alias("style"), start.try_cast("long").alias("start"), F.lit(step).alias("step"), F.lit(confidence).alias("confidence")).cast(kinds)

    def query(key, style, step, confidence):
        # only the first value of a repeated parameter counts
        value = F.regexp_extract(s, rf"^[^?#]*\?(?:(?!{key}=)[^&#]*&)*{key}=([^&#]*)", 1)
        return F.when(s.rlike(_ABSOLUTE) & value.rlike(r"^\d+$"), answer("query", key, style, value, step, confidence))

    number = F.regexp_extract(F.regexp_extract(s, _WEB, 3), r"(?i)/page/(\d+)(?:/|$)", 1)
    none = F.struct(F.lit(False), *(F.lit(None) for _ in range(6))).cast(kinds)
    return F.coalesce(*(query(k, "page", 1, "high") for k in PAGE_KEYS), F.when(number != "", answer("path", "page", "page", number, 1, "high")), *(query(k, "offset", 0, "medium") for k in OFFSET_KEYS), none)


def next_page(c, kind: str, key: str, value) -> Column:
    """The URL of another page, or null if the pattern is not in it."""
    s, value = col(c), col(value) if isinstance(value, (str, Column)) else F.lit(value)
    value = value.cast("string")
    if kind == "path":
        pattern = f"(?i)^(.*?/{key}/)\\d+"
        return F.when(s.rlike(pattern), F.concat(F.regexp_extract(s, pattern, 1), value, F.regexp_replace(s, pattern, "")))
    there = rf"^([^?#]*\?(?:(?!{key}=)[^&#]*&)*{key}=)([^&#]*)"
    query = rf"^([^#]*\?[^#]+)"
    bare = r"^([^?#]*)\??"
    after = lambda p: F.regexp_replace(s, p, "")
    put = lambda mark: F.concat(F.lit(f"{mark}{key}="), value)
    return F.when(s.rlike(there), F.concat(F.regexp_extract(s, there, 1), value, after(there))).when(s.rlike(query), F.concat(F.regexp_extract(s, query, 1), put("&"), after(query))).when(s.rlike(_ABSOLUTE), F.concat(F.regexp_extract(s, bare, 1), put("?"), after(bare)))


def hostname(c) -> Column:
    """A host name without www., in lower case."""
    return F.regexp_replace(F.lower(col(c)), r"^www\.", "")


def same_origin(c, host) -> Column:
    found = F.regexp_replace(F.lower(F.regexp_extract(col(c), _WEB, 2)), r":\d*$", "")
    return F.coalesce((found != "") & (found == col(host)), F.lit(False))


def image_key(c, mode: str = "exact") -> Column:
    return F.regexp_replace(col(c), "[?#].*$", "") if mode == "ignore-query" else col(c)


def safe_file_name(c) -> Column:
    """Without characters that file systems refuse, at most 150 long."""
    s = F.regexp_replace(text(c), r'[<>:"/\\|?*\x00-\x1F]', "")
    s = F.regexp_replace(strip(F.regexp_replace(s, f"{W}+", " ")), r"\.+$", "")
    return F.when(F.length(s) > 150, strip(F.substring(s, 1, 150))).otherwise(s)


def safe_folder_name(c) -> Column:
    parts = F.transform(F.split(text(c), "/"), safe_file_name)
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def http_failure(status) -> Column:
    """struct(reason, retryable) of a failed HTTP status; only 429 and 5xx are worth another try."""
    s = col(status)
    code = F.concat(F.lit("HTTP "), s.cast("string"))
    reason = F.when(s == 403, F.concat(F.lit("blocked/permission ("), code, F.lit(")"))).when(s == 429, F.concat(code, F.lit(" (rate limited)"))).otherwise(code)
    return F.when(s.isNotNull(), F.struct(reason.alias("reason"), ((s == 429) | (s >= 500)).alias("retryable")))


def backoff_ms(attempt, base: int = 1000, most: int = 30_000) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), col(attempt) - 1), F.lit(float(most))).cast("long")


def placeholder(c) -> Column:
    """Whether an image address only stands in for a picture that loads later."""
    s = text(c)
    return (s == "") | s.rlike("(?i)^data:image/gif;base64,R0lGODlhAQAB") | (s.rlike("(?i)^data:") & (F.length(s) < 100)) | s.rlike(r"(?i)\b(blank|placeholder|spacer|1x1|transparent|noimage|no[-_]?photo|dummy)\b")


def best_of_srcset(c) -> Column:
    """The widest candidate, else the densest, else the first; of equals the first listed; '' if there is none."""
    entries = F.filter(F.transform(F.split(text(c), ","), strip), lambda e: e != "")
    parts = F.transform(entries, lambda e, i: F.struct(F.regexp_extract(e, r"^(\S+)", 1).alias("url"), F.regexp_extract(e, rf"^\S+{W}+(\d+)[wW](?:{W}|$)", 1).try_cast("double").alias("w"), F.regexp_extract(e, rf"^\S+{W}+(\d+(?:\.\d+)?)[xX](?:{W}|$)", 1).try_cast("double").alias("x"), (-i).alias("order")))

    def best(by: str) -> Column:
        sized = F.filter(parts, lambda p: p[by].isNotNull())
        return F.array_max(F.transform(sized, lambda p: F.struct(p[by].alias("size"), p["order"].alias("order"), p["url"].alias("url"))))["url"]

    return F.coalesce(best("w"), best("x"), F.get(parts, F.lit(0))["url"], F.lit(""))
