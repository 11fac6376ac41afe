"""URLs and web log fields as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from adtally.functions.numbers import trimmed

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Text that has a character outside this set needs encoding. Fixed value.
_UNSAFE = r"[^a-zA-Z0-9\-_.~%?:/#=&@*\[\]{}|!]"
# scheme, host, port, path, query and fragment; a user name before the host is dropped.
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*://)(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
_IS_URL = r"^(?i:https?|ftp)://[^\s/?#]+\S*$"
_PUNYCODE_LABEL = re.compile(r"(?i)xn--[a-z0-9-]+")


def clean_url(text: Column) -> Column:
    """An http(s) URL from what a person pasted; null if there is none.

    Schemes pasted twice are removed, a missing or unknown scheme becomes ``http://``.
    """
    value = trimmed(text)
    value = F.regexp_replace(value, r"(?si)^(?:https?://)+(?=http)", "")
    scheme = F.regexp_extract(value, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(value, r"(?s)^.*?://(.*)$", 1)
    known = F.lower(scheme).isin("http", "https")
    return (
        F.when(trimmed(text).isin("", "0"), F.lit(None))
        .when(~F.contains(value, F.lit("://")), F.concat(F.lit("http://"), value))
        .when(rest.isin("", "0"), F.lit(None))
        .when(known, F.concat(F.lower(scheme), F.lit("://"), rest))
        .otherwise(F.concat(F.lit("http://"), value))
    )


def visitor_ip(remote: Column, forwarded: Column, is_trusted: Column) -> Column:
    """``real/proxy`` behind a trusted proxy that names a valid IPv4, else the remote address."""
    listed = F.transform(F.split(forwarded, ","), trimmed)
    real = F.get(F.filter(listed, lambda address: address.rlike(_IPV4)), F.lit(0))
    behind_proxy = F.coalesce(is_trusted, F.lit(False)) & real.isNotNull()
    return F.when(behind_proxy, F.concat(real, F.lit("/"), remote)).otherwise(remote)


def script_name(request_uri: Column) -> Column:
    """Request URI without its query."""
    return F.regexp_replace(request_uri, r"^([^?]+)[^\n]*", "$1")


def form_encoded(text: Column) -> Column:
    """Percent encoding with blanks as ``+``; only letters, digits, ``-``, ``_`` and ``.`` stay."""
    return F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))


def _path_encoded(text: Column) -> Column:
    return F.replace(form_encoded(text), F.lit("%2F"), F.lit("/"))


# Both host conversions are defined inside functions, so that executors get their code with
# the task and do not need this package installed. Names follow the rules of 2008 (UTS 46) of
# the public package idna; without it on the executors those of 2003 in Python's own codec.
def _host_to_ascii(hosts: Column) -> Column:
    """International host names in their ASCII form; a name without one stays as it is."""

    def convert(host: str) -> str:
        try:
            import idna
        except ImportError:
            idna = None
        try:
            if idna is None:
                return host.encode("idna").decode("ascii")
            return idna.encode(host, uts46=True).decode("ascii")
        except UnicodeError:
            return host

    def convert_batch(batch: pd.Series) -> pd.Series:
        return batch.map(convert, na_action="ignore")

    return F.pandas_udf(convert_batch, StringType())(hosts)


def _labels_to_unicode(texts: Column) -> Column:
    """ASCII forms inside a text as international names; an invalid one stays as it is."""
    label_pattern = _PUNYCODE_LABEL

    def readable(label: re.Match) -> str:
        try:
            import idna
        except ImportError:
            idna = None
        try:
            if idna is None:
                return label.group().encode("ascii").decode("idna")
            return idna.decode(label.group())
        except UnicodeError:
            return label.group()

    def convert_batch(batch: pd.Series) -> pd.Series:
        return batch.map(lambda text: label_pattern.sub(readable, text), na_action="ignore")

    return F.pandas_udf(convert_batch, StringType())(texts)


def smart_encode(text: Column) -> Column:
    """Encode a text only if it has characters that need it.

    In a URL the host becomes ASCII, path and query are encoded as a whole where they have
    such characters (also their ``=`` and ``&``), and a user name is dropped. Other texts are
    encoded with their slashes kept. Python sees only host names that are not ASCII.
    """
    part = {
        name: F.regexp_extract(text, _URL, number)
        for number, name in enumerate(("scheme", "host", "port", "path", "query", "fragment"), 1)
    }
    host = part["host"]
    foreign_host = F.when(F.rlike(text, F.lit(_IS_URL)) & host.rlike(r"[^\x00-\x7F]"), host)
    ascii_host = F.coalesce(_host_to_ascii(foreign_host), host)
    path = F.when(part["path"].rlike(_UNSAFE), _path_encoded(part["path"])).otherwise(part["path"])
    asked = F.substr(part["query"], F.lit(2))
    query = F.when(asked.rlike(_UNSAFE), F.concat(F.lit("?"), form_encoded(asked))).otherwise(part["query"])
    url = F.concat(part["scheme"], ascii_host, part["port"], path, query, part["fragment"])
    return (
        F.when(~text.rlike(_UNSAFE), text)
        .when(text.rlike(_IS_URL), url)
        .otherwise(_path_encoded(text))
    )


def smart_decode(text: Column) -> Column:
    """Undo percent encoding and show ASCII forms of international names as they are read.

    A percent sign that starts no code is kept.
    """
    closed = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.url_decode(closed)
    with_labels = F.when(F.contains(F.lower(decoded), F.lit("xn--")), decoded)
    return F.coalesce(_labels_to_unicode(with_labels), decoded)
