"""URL expressions. One pattern takes a URL apart; invalid input gives null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import bind, nonempty, strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# scheme, authority, path, query, fragment
WEB = r"(?i)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# Characters that are written as bytes in a path, a query and a fragment; segments that mean here and up.
IN_PATH, IN_QUERY, IN_FRAGMENT = (rf"[^\x21-\x7e]|[{more}]" for more in (r'"#<>?^`{}', r"\"#<>'", r'"<>`'))
HERE, UP = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
HOST_OK = r"^([^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+|\[[0-9A-Fa-f:.]+\])$"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(strip(url), r"[\t\r\n]", "")


def _host(tidy: Column) -> Column:
    """Host and port, without user information."""
    return F.regexp_replace(F.regexp_extract(tidy, WEB, 2), "^.*@", "")


def _port(tidy: Column) -> Column:
    return F.regexp_extract(_host(tidy), ":([0-9]*)$", 1)


def _name(tidy: Column) -> Column:
    return F.regexp_replace(_host(tidy), ":[0-9]*$", "")


def _is_web(tidy: Column) -> Column:
    port_ok = bind(
        _port(tidy),
        lambda port: (F.length(port) <= 8) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535),
    )
    return F.coalesce(tidy.rlike(WEB) & _name(tidy).rlike(HOST_OK) & port_ok, F.lit(False))


def _escaped(part: Column, characters: str) -> Column:
    """``part`` with the given characters as ``%`` and two digits for each byte; nearly all have none of them."""
    def written(c: Column) -> Column:
        return F.when(c.rlike(characters), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)

    return F.when(part.rlike(characters), F.array_join(F.transform(F.split(part, ""), written), "")).otherwise(part)


def _path(tidy: Column) -> Column:
    """Path in normal form: ``.`` and ``..`` are followed, and gone."""
    raw = _escaped(F.regexp_replace(F.regexp_extract(tidy, WEB, 3), r"\\", "/"), IN_PATH)
    none = F.array().cast("array<string>")

    def step(done: Column, segment: Column) -> Column:
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment.rlike(UP), back).when(segment.rlike(HERE), done).otherwise(F.concat(done, F.array(segment)))

    def followed(path: Column) -> Column:
        segments = F.split(F.regexp_replace(path, "^/", ""), "/")
        last = F.element_at(segments, -1)
        walked = F.aggregate(segments, none, step)
        # A path that ends with such a segment ends in the folder it means.
        whole = F.when(last.rlike(HERE) | last.rlike(UP), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
        return F.concat(F.lit("/"), F.array_join(whole, "/"))

    return bind(raw, lambda path: F.when(path.rlike(r"(?i)/(\.|%2e)"), followed(path)).otherwise(F.coalesce(nonempty(path), F.lit("/"))))


def _query(tidy: Column) -> Column:
    return _escaped(F.regexp_extract(tidy, WEB, 4), IN_QUERY)


def _scheme(tidy: Column) -> Column:
    return F.lower(F.regexp_extract(tidy, SCHEME, 1))


def _base(tidy: Column) -> Column:
    default = F.when(_scheme(tidy) == "http", F.lit("80")).otherwise(F.lit("443"))
    shown = bind(
        F.regexp_replace(_port(tidy), "^0+(?=[0-9])", ""),
        lambda port: F.when((port == "") | (port == default), F.lit("")).otherwise(
            F.concat(F.lit(":"), port)
        ),
    )
    return F.concat(_scheme(tidy), F.lit("://"), F.lower(_name(tidy)), shown, _path(tidy))


def _web(url: Column, value: Callable[[Column], Column]) -> Column:
    """``value`` of a web address; null for anything else."""
    return bind(_tidy(url), lambda tidy: F.when(_is_web(tidy), value(tidy)))


def is_web(url: Column) -> Column:
    """True for http and https addresses with a usable host and port."""
    return F.coalesce(bind(_tidy(url), _is_web), F.lit(False))


def is_url(url: Column) -> Column:
    """True for anything a browser would accept as an absolute address."""
    return F.coalesce(
        bind(
            _tidy(url),
            lambda t: _is_web(t) | (t.rlike(SCHEME) & ~t.rlike("(?i)^(https?|wss?|ftp):")),
        ),
        F.lit(False),
    )


def scheme(url: Column) -> Column:
    return _scheme(_tidy(url))


def hostname(url: Column) -> Column:
    """Lower-case host; empty for anything that is not a web address."""
    return F.coalesce(_web(url, lambda t: F.lower(_name(t))), F.lit(""))


def path(url: Column) -> Column:
    return _web(url, _path)


def path_and_query(url: Column) -> Column:
    return _web(
        url, lambda t: F.concat(_path(t), F.regexp_replace(_query(t), r"^\?$", ""))
    )


def strip_fragment(url: Column) -> Column:
    """Web address without its fragment, in normal form; null for anything else."""
    return _web(url, lambda t: F.concat(_base(t), _query(t)))


def safe_http(url: Column) -> Column:
    """Normal form of a web address that is safe to link to; null for anything else."""
    return _web(
        url, lambda t: F.concat(_base(t), _query(t), _escaped(F.regexp_extract(t, WEB, 5), IN_FRAGMENT))
    )


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``: the names a domain rule for this host may carry."""
    return bind(
        F.split(host, r"\."),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        ),
    )
