"""URL normalisation with the parsing rules browsers use, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import IMAGE_EXTENSION, IMAGE_PROXY_URL, TRACKING_PARAM
from .text import NOT_SPACE, SPACE_CHARS, let, text_or_empty, trim_all

_WEB = r"(?i)^(https?|ftp|wss?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_OTHER = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_BAD_HOST = r"[\x00-\x20\"%<>^`{|}]|^\[?$"
_QUERY_CHARS = r"[!$-&(-;=?-_a-~]"
_URL_TRIM = "".join(map(chr, range(0x21)))


def _encode(c: Column, keep: str) -> Column:
    """Percent-encode the characters outside ``keep``; untouched when there are none."""
    def encoded(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, ""), lambda ch: F.when(ch.rlike(f"^{keep}$"), ch).otherwise(
            F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20")))), "")

    return let(c, lambda text: F.when(text.rlike(f"^{keep}*$"), text).otherwise(encoded(text)))


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    def step(done, part):
        up = F.lower(part).isin("..", ".%2e", "%2e.", "%2e%2e")
        stay = F.lower(part).isin(".", "%2e")
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(up, shorter).when(stay, done).otherwise(F.concat(done, F.array(part)))

    def resolved(p: Column) -> Column:
        parts = F.split(F.substring(p, 2, 1 << 30), "/")
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(
            p.rlike(r"(?i)/(\.|%2e){1,2}$") & (F.size(k) > 0), "/").otherwise("")))

    return let(path, lambda p: F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), resolved(p)).otherwise(p))


def _parse(c) -> Column:
    """Scheme, host, authority, path and query as browsers read them; ``web`` tells whether it is one."""
    def build(text: Column) -> Column:
        authority = F.regexp_extract(text, _WEB, 2)
        return let(F.struct(
            F.lower(F.regexp_extract(text, _WEB, 1)).alias("scheme"),
            F.regexp_extract(authority, "^(.*@)", 1).alias("user"),
            F.lower(F.regexp_replace(authority, "^.*@", "")).alias("host_port"),
            F.replace(F.regexp_extract(text, _WEB, 3), F.lit("\\"), F.lit("/")).alias("path"),
            F.regexp_extract(text, _WEB, 4).alias("query"), text.alias("all")), finish)

    def finish(u: Column) -> Column:
        scheme = u["scheme"]
        port = F.regexp_extract(u["host_port"], r":(\d*)$", 1)
        host = F.regexp_replace(u["host_port"], r":\d*$", "")
        default = F.when(scheme.isin("http", "ws"), "80").when(scheme.isin("https", "wss"), "443").otherwise("21")
        shown = F.when((port == "") | (port == default), host).otherwise(F.concat(host, F.lit(":"), port))
        web = (scheme != "") & (host != "") & ~host.rlike(_BAD_HOST) & (
            ~host.contains(":") | host.rlike(r"^\[[0-9a-f:.]+\]$"))
        return F.struct(
            scheme.alias("scheme"), host.alias("host"), u["user"].alias("user"), shown.alias("place"),
            F.when(u["path"] == "", "/").otherwise(
                _resolve_dots(_encode(u["path"], r"[!$-;=@-\[\]-_a-z|~]"))).alias("path"),
            u["query"].alias("query"), web.alias("web"),
            ((scheme == "") & u["all"].rlike(_OTHER)).alias("other"), u["all"].alias("all"))

    return let(F.regexp_replace(F.btrim(text_or_empty(c), F.lit(_URL_TRIM)), r"[\t\n\r]", ""), build)


def _drop_params(query: Column, pattern: str) -> Column:
    """Remove the matching parameters; the rest is re-encoded as a form only when one was removed."""
    def decoded(x):
        return F.coalesce(F.try_url_decode(x), x)

    def tracked(p):
        return decoded(F.substring_index(p, "=", 1)).rlike(f"(?i){pattern}")

    def form(p):
        name = F.substring_index(p, "=", 1)
        value = F.substring(p, F.length(name) + 2, F.length(p))
        return F.concat(F.url_encode(decoded(name)), F.lit("="), F.url_encode(decoded(value)))

    def rebuilt(pairs):
        kept = F.transform(F.filter(pairs, lambda p: ~tracked(p)), form)
        rest = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))
        return F.when(F.exists(pairs, tracked), rest).otherwise(_encode(query, _QUERY_CHARS))

    return let(F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: p != ""), rebuilt)


def _href(c, drop: str | None = None) -> Column:
    """Parsed form without fragment; null when the text is not an absolute URL."""
    def build(u: Column) -> Column:
        query = _drop_params(u["query"], drop) if drop else _encode(u["query"], _QUERY_CHARS)
        web = F.concat(u["scheme"], F.lit("://"), u["user"], u["place"], u["path"], query)
        return F.when(u["web"], web).when(u["other"], F.regexp_replace(u["all"], "(?s)#.*", ""))

    return let(_parse(c), build)


# Addresses that parsing leaves as they are, apart from the fragment: lower-case host without port or
# user, no characters to encode, no dot segments. Most are of this form; the others take the long way.
_PLAIN = r"^https?://[a-z0-9.-]+(?:/[!$-;=@-\[\]-_a-z|~]*(?:\?[!$&(-;=?-_a-~]*)?)?(?:#[^\r\n]*)?$"
# The same with name=value pairs that form encoding leaves as they are, so pairs can be cut out of the text.
_WORD = "[A-Za-z0-9*._-]"
_SIMPLE_QUERY = (rf"^https?://[a-z0-9.-]+/[!$-;=@-\[\]-_a-z|~]*\?{_WORD}+={_WORD}*(?:&{_WORD}+={_WORD}*)*(?:#[^\r\n]*)?$")
_TRACKED_PAIR = rf"(?i)(?<=[?&])(?:utm_{_WORD}*|fbclid|gclid|ref|ref_src)={_WORD}*(?:&|\z)"
# Web addresses whose host is plain lower-case text without user or port, up to the first separator.
_PLAIN_HOST = r"^(https?://([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?))(?:[/?#][!-~]*)?$"
_DOTS = r"(?i)/(?:\.|%2e)"
_MAYBE_TRACKED = r"(?i)[?&](?:utm_|fbclid|gclid|ref)"


def norm_url_dedupe(c) -> Column:
    """Key for de-duplication: no tracking parameters, fragment or final slash, lower case."""
    c = text_or_empty(c)
    plain = c.rlike(_PLAIN) & ~c.rlike(f"{_DOTS}|{_MAYBE_TRACKED}")
    simple = c.rlike(_SIMPLE_QUERY) & ~c.rlike(_DOTS)
    bare = F.substring_index(c, "#", 1)
    dropped = F.regexp_replace(F.regexp_replace(bare, _TRACKED_PAIR, ""), r"[?&]\z", "")
    key = F.when(plain, bare).when(simple, dropped).otherwise(
        F.coalesce(_href(c, TRACKING_PARAM), F.btrim(c, F.lit(SPACE_CHARS))))
    return F.lower(F.regexp_replace(key, r"/\z", ""))


def norm_title_dedupe(c) -> Column:
    """Key for de-duplication: lower case, no URLs, only letters and digits separated by blanks."""
    c = F.regexp_replace(F.lower(text_or_empty(c)), f"https?://{NOT_SPACE}+", "")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def clean_url(c) -> Column:
    return F.regexp_replace(trim_all(text_or_empty(c)), r"[),，。！？；;]+\z", "")


def norm_url_link(c) -> Column:
    """Link form for allow-lists: no fragment and no final slash."""
    def form(u: Column) -> Column:
        plain = u.rlike(_PLAIN) & ~u.rlike(_DOTS)
        return F.regexp_replace(F.when(plain, F.substring_index(u, "#", 1)).otherwise(F.coalesce(_href(u), u)), r"/\z", "")

    return let(clean_url(c), form)


def url_origin(c) -> Column:
    """Scheme, host and port; null when the text is not a web address."""
    def long(u: Column) -> Column:
        return F.when(u["web"], F.concat(u["scheme"], F.lit("://"), u["place"]))

    return let(text_or_empty(c), lambda u: F.when(
        u.rlike(_PLAIN_HOST), F.regexp_extract(u, _PLAIN_HOST, 1)).otherwise(let(_parse(u), long)))


def url_host(c) -> Column:
    return let(text_or_empty(c), lambda u: F.when(u.rlike(_PLAIN_HOST), F.regexp_extract(u, _PLAIN_HOST, 2)).otherwise(
        let(_parse(u), lambda x: F.when(x["web"], x["host"]))))


def on_host(c, host: str) -> Column:
    """True for the host itself and its sub-domains."""
    return F.coalesce(let(url_host(c), lambda h: (h == host) | h.endswith("." + host)), F.lit(False))


def is_image_url(c) -> Column:
    """Image extension, also behind nested forms of the image proxy address."""
    def unwrap(url: Column) -> Column:
        inner = F.try_url_decode(F.regexp_extract(url, IMAGE_PROXY_URL + r"(.*?)(\?url=.*)?$", 1))
        return F.when(url.rlike(IMAGE_PROXY_URL), clean_url(F.coalesce(inner, F.lit("")))).otherwise(url)

    url = clean_url(c)
    for _ in range(3):
        url = let(url, unwrap)
    return let(url, lambda u: ~u.rlike(IMAGE_PROXY_URL) & u.rlike(IMAGE_EXTENSION))
