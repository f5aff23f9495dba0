"""Host names of URLs: the registrable domain, a short service name, and hosts without delivery-network labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes under which a registrable domain has one label more.
MULTIPART_SUFFIXES = tuple(
    """co.uk org.uk me.uk ac.uk gov.uk net.uk sch.uk ltd.uk plc.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz govt.nz ac.nz
    co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ne.kr com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn co.za org.za net.za
    com.mx com.ar com.tr com.sg com.hk com.tw com.my com.ph com.vn co.in net.in org.in gov.in com.pl net.pl org.pl co.il org.il net.il
    github.io gitlab.io pages.dev workers.dev netlify.app vercel.app s3.amazonaws.com storage.googleapis.com blob.core.windows.net""".split()
)
# A first label that names a bucket, not a service; and leading labels that say nothing of who serves.
BUCKET = r"^(?:www\d*|cdn\d*|static\d*|media\d*|files?|assets?|storage|store|s3|content|data)$"
DECORATION = (
    r"^(?:d|dl|cdn\d*|static\d*|media\d*|img\d*|image\d*|images|i|ii|is\d*|files?|assets?|content|thumb(?:nail)?s?|preview|video\d*|v|vid|"
    r"stream\d*|download(?:s)?|uploads?|store|storage|data|res|resource|pbs|edge|cache|fs|f|c|s|t|p|www\d*|web|api|gw|proxy|akamai|"
    r"scontent(?:-[a-z0-9-]+)?|instagram|fna|xx|global|origin|[a-z]{2}\d?|[a-z]{1,3}-?\d{1,4}|eu|us|uk|asia|ap|na)$"
)
ADDRESS = r"^\d{1,3}(?:\.\d{1,3}){3}$"


def url_host(url: Column) -> Column:
    """The host of an absolute URL, lower-cased, without user and port; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def registrable(host: Column) -> Column:
    """The domain somebody registered: its last two labels, or one more than a suffix of several."""
    clean = F.regexp_replace(F.lower(F.trim(host)), r"\.+$", "")
    clean = F.regexp_extract(F.regexp_extract(clean, r"([^@]*)$", 1), r"^([^:]*)", 1)
    labels = _labels(clean)
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    several = lambda n: (F.size(labels) > n) & last(n).isin(*MULTIPART_SUFFIXES)
    return (
        F.when(clean == "", None).when(clean.rlike(ADDRESS), clean).when(F.size(labels) <= 2, F.array_join(labels, "."))
        .when(several(3), last(4)).when(several(2), last(3)).otherwise(last(2))
    )


def source(host: Column) -> Column:
    """A short name of the service: the first label of its domain, or all of it where that label is a bucket."""
    domain = registrable(host)
    first = F.substring_index(domain, ".", 1)
    return F.when(domain.rlike(ADDRESS) | (first.rlike(BUCKET) & domain.contains(".")), domain).otherwise(first)


def strip_decoration(host: Column) -> Column:
    """The host without leading delivery-network labels, two labels at least."""
    labels = _labels(F.lower(host))
    start = F.struct(F.lit(True).alias("leading"), F.lit(0).alias("n"))
    kept = F.aggregate(
        labels, start,
        lambda acc, x: F.struct((acc["leading"] & x.rlike(DECORATION)).alias("leading"), (acc["n"] + (acc["leading"] & x.rlike(DECORATION)).cast("int")).alias("n")),
        lambda acc: acc["n"],
    )
    drop = F.least(kept, F.greatest(F.size(labels) - 2, F.lit(0)))
    return F.when(host.isNotNull() & (host != ""), F.array_join(F.slice(labels, drop + 1, F.greatest(F.size(labels), F.lit(1))), "."))


def first_marker(text: Column, markers: list[tuple[str, str]]) -> Column:
    """The label of the first marker, in their order, that the text contains."""
    return reduce(lambda c, m: c.when(text.contains(m[0]), m[1]), markers[1:], F.when(text.contains(markers[0][0]), markers[0][1]))
