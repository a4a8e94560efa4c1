"""URL column functions."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.constants import BINARY_SUFFIXES, BLOCKED_HOSTS, BLOCKED_SUFFIXES, NOISE_PATTERN, PAGE_RULES, TRACKING
from tidemark.functions.text import let

_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without its trailing dots, an IPv6 address in its brackets; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY + r"(\[[^\]]*\]|[^\[:/?#]*)", 1)), r"\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY + r"(?:\[[^\]]*\]|[^\[:/?#]*):(\d+)", 1).try_cast("int")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pairs(text: Column) -> Column:
    """A query's keys and values, decoded and sorted, without tracking parameters; blank values stay."""

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        return F.struct(_decoded(key).alias("key"), _decoded(F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise("")).alias("value"))

    found = F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), pair)
    return F.array_sort(F.filter(found, lambda p: ~F.lower(p["key"]).isin(*TRACKING)))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, tracking parameters or closing slash, the rest of the query sorted and encoded anew.

    A path stays as it is, but for parameters after a semicolon in its last part.  A URL without a host is only trimmed.
    """
    parts = F.struct(
        scheme(url).alias("scheme"), host(url).alias("host"), port(url).alias("port"), F.regexp_replace(path(url), ";[^/]*$", "").alias("path"), query(url).alias("query")
    )

    def whole(x: Column) -> Column:
        odd = F.when(x["port"].isNotNull() & ~x["port"].isin(0, 80, 443), F.concat(F.lit(":"), x["port"].cast("string"))).otherwise("")
        place = F.regexp_replace(x["path"], "/+$", "")
        terms = F.array_join(F.transform(_pairs(x["query"]), lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")
        tail = F.when(x["query"] == "", "").otherwise(let(terms, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))
        return F.when(x["host"] == "", F.trim(url)).otherwise(F.concat(x["scheme"], F.lit("://"), x["host"], odd, F.when(place == "", "/").otherwise(place), tail))

    return let(parts, whole)


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def favicon_url(url: Column) -> Column:
    """The favicon at the site's own scheme and authority."""
    return F.concat(F.regexp_extract(F.trim(url), "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/favicon.ico"))


def website(url: Column) -> Column:
    """``struct<url, domain, error_code>`` of a site's address as a user gives it: https where no scheme is named, checked and normalised."""
    given = F.trim(F.coalesce(url, F.lit("")))
    given = F.when(F.contains(given, F.lit("://")), given).otherwise(F.concat(F.lit("https://"), given))

    def judge(x: Column) -> Column:
        code = F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "url_required").when(x["code"].isNotNull(), x["code"]).when(~F.contains(x["domain"], F.lit(".")), "url_invalid")
        return F.struct(F.when(code.isNull(), x["url"]).alias("url"), F.when(code.isNull(), x["domain"]).alias("domain"), code.alias("error_code"))

    return let(F.struct(normalize_url(given).alias("url"), domain(given).alias("domain"), safety_code(given).alias("code")), judge)


def domain(url: Column) -> Column:
    return F.regexp_replace(host(F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))), r"^www\.", "")


def same_site(url: Column, base: Column) -> Column:
    return (domain(url) == base) | F.endswith(domain(url), F.concat(F.lit("."), base))


def is_binary(url: Column) -> Column:
    return F.regexp_like(F.lower(path(url)), F.lit(r"\.(" + "|".join(BINARY_SUFFIXES) + ")$"))


# Address ranges that are not public, as first address and prefix length.
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
PRIVATE_6 = (("::", 128), ("::1", 128), ("64:ff9b:1::", 48), ("100::", 64), ("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("3fff::", 20), ("fc00::", 7), ("fe80::", 10), ("fec0::", 10), ("ff00::", 8))
MAPPED_6 = ("::ffff:0:0", 96)


def private_ranges() -> list[tuple[int, int]]:
    """The ranges' first and past-the-last addresses as numbers."""
    nets = [ipaddress.ip_network(f"{a}/{n}") for a, n in PRIVATE]
    return [(int(net[0]), int(net[0]) + net.num_addresses) for net in nets]


def _is_private_4(number: Column) -> Column:
    ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in private_ranges()])
    return F.exists(ranges, lambda r: (number >= r["a"]) & (number < r["b"]))


def _bits_6(host: Column) -> Column:
    """The 128 bits of an IPv6 address in brackets as a string; null if it is none."""
    inner = F.regexp_replace(host, r"^\[|%.*|\]$", "")
    dotted = F.transform(F.split(F.regexp_extract(inner, r"(\d+\.\d+\.\d+\.\d+)$", 1), r"\."), lambda o: F.lpad(F.hex(o.try_cast("long")), 2, "0"))
    inner = F.when(F.contains(inner, F.lit(".")), F.concat(F.regexp_replace(inner, r"[\d.]+$", ""), F.get(dotted, F.lit(0)), F.get(dotted, F.lit(1)), F.lit(":"), F.get(dotted, F.lit(2)), F.get(dotted, F.lit(3)))).otherwise(inner)

    def bits(x: Column) -> Column:
        group = lambda part: F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda g: g != "")
        left, right = group(F.get(F.split(x, "::"), F.lit(0))), group(F.get(F.split(x, "::"), F.lit(1)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
        whole = F.when(F.contains(x, F.lit("::")), (F.size(F.split(x, "::")) == 2) & (F.size(left) + F.size(right) < 8)).otherwise(F.size(left) == 8)
        return F.when(whole, F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    return F.when(F.regexp_like(inner, F.lit("^[0-9a-f:]+$")), let(inner, lambda x: let(bits(x), lambda b: F.when(F.length(b) == 128, b))))


def _prefix_6(address: str, n: int) -> str:
    return f"{int(ipaddress.ip_address(address)):0128b}"[:n]


def safety_code(url: Column) -> Column:
    """Why a URL must not be fetched, null if it may be; names are judged as they stand, without a lookup."""
    blocked = "(" + "|".join(s.replace(".", r"\.") for s in BLOCKED_SUFFIXES) + ")$"

    def judge(x: Column) -> Column:
        h, four, six = x["host"], F.regexp_like(x["host"], F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")), F.startswith(x["host"], F.lit("["))
        digits = F.transform(F.split(h, r"\."), lambda o: o.try_cast("long"))
        number = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)

        def private_6(bits: Column) -> Column:
            mapped = F.when(F.startswith(bits, F.lit(_prefix_6(*MAPPED_6))), let(F.conv(F.substring(bits, 97, 32), 2, 10).cast("long"), _is_private_4)).otherwise(False)
            own = F.regexp_like(bits, F.lit("^(" + "|".join(_prefix_6(*net) for net in PRIVATE_6) + ")"))
            return F.coalesce(own | mapped, F.lit(True))

        private = F.when(four, let(number, _is_private_4)).when(six, let(_bits_6(h), private_6)).otherwise(False)
        return (
            F.when(~x["scheme"].isin("http", "https"), "scheme_not_allowed").when(x["credentials"], "credentials_in_url").when(h == "", "missing_hostname")
            .when(x["port"].isNotNull() & ~x["port"].isin(80, 443), "port_not_allowed").when(h.isin(*BLOCKED_HOSTS) | F.regexp_like(h, F.lit(blocked)), "host_not_allowed")
            .when(private, "private_address").when(~four & ~six & ~F.contains(h, F.lit(".")), "host_not_allowed")
        )

    credentials = F.regexp_like(url, F.lit(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"))
    return let(F.struct(scheme(url).alias("scheme"), host(url).alias("host"), port(url).alias("port"), credentials.alias("credentials")), judge)


def classify(url: Column, anchor: Column) -> Column:
    """``struct<page_type, score>``: the first rule with the best value, lowered for depth and listings.

    Rules are literal conditions on the URL's parts, which are computed once.
    """

    def value(x: Column, base: float, words: tuple[str, ...], anchors: tuple[str, ...]) -> Column:
        like = lambda names: F.lit("(?:" + "|".join(re.escape(w) for w in names) + ")")
        return (
            F.when(x["first"].isin(*words), base).when(x["label"].isin(*anchors), base * 0.9).when(F.arrays_overlap(x["segments"], F.array(*map(F.lit, words))), base * 0.8)
            .when(F.regexp_like(x["label"], like(anchors)), base * 0.6).when(F.regexp_like(x["path"], like(words)), base * 0.5).otherwise(0.0)
        )

    def judge(x: Column) -> Column:
        values = F.array(*[value(x, base, words, anchors) for _, base, words, anchors in PAGE_RULES])

        def best(v: Column) -> Column:
            top = F.array_max(v)
            kind = F.when(top > 1.0, F.get(F.array(*[F.lit(r[0]) for r in PAGE_RULES]), (F.array_position(v, top) - 1).cast("int"))).otherwise("other")
            depth = F.when(F.size(x["segments"]) > 1, F.greatest(F.lit(0.35), 1.0 - 0.18 * (F.size(x["segments"]) - 1))).otherwise(1.0)
            return F.struct(kind.alias("page_type"), F.bround(F.greatest(top, F.lit(1.0)) * depth * x["noise"], 3).alias("score"))

        return F.when(x["path"] == "", F.struct(F.lit("home").alias("page_type"), F.lit(12.0).alias("score"))).otherwise(let(values, best))

    noise = F.when(F.regexp_like(url, F.lit(NOISE_PATTERN)), 0.3).otherwise(1.0)
    label = F.lower(F.trim(F.coalesce(anchor, F.lit(""))))

    def with_segments(q: Column) -> Column:
        segments = F.filter(F.split(q, "/"), lambda s: s != "")
        return let(segments, lambda s: judge_of(q, s))

    def judge_of(q: Column, segments: Column) -> Column:
        parts = F.struct(q.alias("path"), segments.alias("segments"), F.coalesce(F.get(segments, F.lit(0)), F.lit("")).alias("first"), label.alias("label"), noise.alias("noise"))
        return let(parts, judge)

    return let(F.regexp_replace(F.lower(path(url)), "^/+|/+$", ""), with_segments)
