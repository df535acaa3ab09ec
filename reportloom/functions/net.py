"""Hosts, addresses and registered domains as columns."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Most labels of a rule in the public suffix list.
MOST_LABELS = 5
NORMAL, WILDCARD, EXCEPTION = 1, 2, 4
# Address ranges that are not public, as first and last address; and two addresses inside them that are.
NOT_PUBLIC = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]
PUBLIC_AFTER_ALL = ["192.0.0.9", "192.0.0.10"]
PORT = r"(?U)\b((?:\d{1,3}\.){3}\d{1,3})\s*[:：]\s*(\d{1,5})\b"


def split_urls(value: Column) -> Column:
    """Urls that were run together, cut where each scheme starts; what precedes the first is dropped if there are several."""
    scheme = "(?:https?|ftp)://"
    many = F.regexp_count(value, F.lit(f"(?iu){scheme}")) > 1
    return F.when(many, F.regexp_extract_all(value, F.lit(rf"(?ius){scheme}.*?(?={scheme}|\z)"), 0)).otherwise(F.array(value))


def url_host(value: Column) -> Column:
    """What lies between the scheme and the first slash or colon."""
    rest = F.regexp_replace(value, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.substring_index(F.substring_index(rest, "/", 1), ":", 1)


def number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return a << 24 | b << 16 | c << 8 | d


_FIRST, _LAST = ([number(r[k]) for r in NOT_PUBLIC] for k in (0, 1))


def is_public(address: str) -> bool:
    """As is_public_ipv4(), of an address that is one."""
    n = number(address)
    k = bisect.bisect_right(_FIRST, n) - 1
    return n > _LAST[k] or address in PUBLIC_AFTER_ALL


def ipv4_number(value: Column) -> Column:
    """The address as a number; null unless it is four octets without leading zeros."""
    octet = "(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    parts = F.split(value, "\\.")
    number = F.lit(0).cast("long")
    for k in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(k + 1)).try_cast("long")
    return F.when(value.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"), number)


def is_public_ipv4(value: Column) -> Column:
    n = ipv4_number(value)
    private = F.lit(False)
    for low, high in NOT_PUBLIC:
        private = private | n.between(number(low), number(high))
    return F.coalesce(n.isin([number(a) for a in PUBLIC_AFTER_ALL]) | ~private, F.lit(False))


def port_for(ip: Column, text: Column) -> Column:
    """The port of the first address:port in text whose address is ip, as a string; else null."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(PORT), 1).alias("ip"), F.regexp_extract_all(text, F.lit(PORT), 2).alias("port"))
    return F.try_element_at(F.filter(pairs, lambda p: p["ip"] == ip), F.lit(1))["port"]


def suffix_rules(spark: SparkSession) -> DataFrame:
    """suffix, kind: the ICANN part of the public suffix list that comes with Spark's HTTP client. Some 7,000 rows."""
    jvm = spark.sparkContext._jvm
    stream = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
    if stream is None:
        raise FileNotFoundError("mozilla/public-suffix-list.txt is not on the class path")
    text = bytes(stream.readAllBytes()).decode("utf-8")
    stream.close()
    # the shipped file may have lost its comments; then all of it is used
    if "===BEGIN ICANN DOMAINS===" in text:
        text = text.split("===BEGIN ICANN DOMAINS===")[1].split("===END ICANN DOMAINS===")[0]
    kinds: dict[str, int] = {}
    for line in text.splitlines():
        rule = line.strip().split(" ")[0].lower()
        if not rule or rule.startswith("//"):
            continue
        kind = EXCEPTION if rule[0] == "!" else WILDCARD if rule.startswith("*.") else NORMAL
        rule = rule.removeprefix("!").removeprefix("*.")
        kinds[rule] = kinds.get(rule, 0) | kind
    return spark.createDataFrame(sorted(kinds.items()), "suffix string, kind int")


def host_of(url: str) -> str:
    """As url_host()."""
    scheme = re.match("[a-zA-Z][a-zA-Z0-9+.-]*://", url)
    return url[scheme.end() if scheme else 0 :].split("/", 1)[0].split(":", 1)[0]


def registered(rules: dict[str, int]) -> Callable[[str], tuple[str, str]]:
    """A function from a host to its registered domain and public suffix, as with_registered_domain() has them."""
    known: dict[str, tuple[str, str]] = {}

    def look_up(host: str) -> tuple[str, str]:
        parts = host.rsplit("@", 1)[-1].rstrip(".").lower().split(".")
        n, usual, exception = len(parts), 0, 0
        for k in range(1, min(n, MOST_LABELS) + 1):
            kind = rules.get(".".join(parts[-k:]), 0)
            usual = max(usual, k if kind & NORMAL else 0, k + 1 if kind & WILDCARD and n > k else 0)
            exception = max(exception, k - 1) if kind & EXCEPTION else exception
        labels = exception or usual
        domain = ".".join(parts[-labels - 1 :]) if 0 < labels < n and parts[-labels - 1] else ""
        return domain, ".".join(parts[-labels:]) if labels else ""

    def of(host: str) -> tuple[str, str]:
        if host not in known:
            if len(known) >= 100_000:
                known.clear()
            known[host] = look_up(host)
        return known[host]

    return of


def with_registered_domain(rows: DataFrame, host: str, rules: DataFrame, domain: str = "domain", suffix: str = "suffix") -> DataFrame:
    """rows with the registered domain of host (lower case, empty if there is none) and its public suffix added.

    The last 1 to MOST_LABELS labels are looked up in rules (bounded by the list, broadcast): an exception wins,
    then the longest rule. An unknown top-level domain has no suffix. Nothing is shuffled.
    """
    host_ = F.lower(F.regexp_replace(F.substring_index(F.coalesce(F.col(host), F.lit("")), "@", -1), "\\.+$", ""))
    rows = rows.withColumn("__host", host_).withColumn("__n", F.size(F.split("__host", "\\.")))
    for k in range(1, MOST_LABELS + 1):
        part = rules.select(F.col("suffix").alias(f"__s{k}"), F.col("kind").alias(f"__k{k}"))
        known = F.when(F.col("__n") >= k, F.substring_index("__host", ".", -k))
        rows = rows.join(F.broadcast(part), known == F.col(f"__s{k}"), "left").drop(f"__s{k}")
    kind = {k: F.coalesce(F.col(f"__k{k}"), F.lit(0)) for k in range(1, MOST_LABELS + 1)}
    usual = [F.when(c.bitwiseAND(NORMAL) > 0, k) for k, c in kind.items()]
    wild = [F.when((c.bitwiseAND(WILDCARD) > 0) & (F.col("__n") > k), k + 1) for k, c in kind.items()]
    except_ = [F.when(c.bitwiseAND(EXCEPTION) > 0, k - 1) for k, c in kind.items()]
    labels = F.coalesce(F.greatest(*except_), F.greatest(*usual, *wild), F.lit(0))
    rows = rows.withColumn("__labels", labels)
    parts = F.split("__host", "\\.")
    tail = lambda n: F.array_join(F.slice(parts, F.greatest(F.col("__n") - n + 1, F.lit(1)), n), ".")
    has = (F.col("__labels") > 0) & (F.col("__n") > F.col("__labels")) & (F.get(parts, F.col("__n") - F.col("__labels") - 1) != "")
    out = {domain: F.when(has, tail(F.col("__labels") + 1)).otherwise(""), suffix: F.when(F.col("__labels") > 0, tail(F.col("__labels"))).otherwise("")}
    return rows.withColumns(out).drop("__host", "__n", "__labels", *[f"__k{k}" for k in range(1, MOST_LABELS + 1)])
