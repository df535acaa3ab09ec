import math

import pytest
from pyspark.sql import functions as F

from reportloom.functions import net, text, yaml


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("hxxps://evil[.]example/a", "https://evil.example/a"),
        ("HXXP ://a(.)b {.}c", "http://a.b .c"),
        ("connect dot com", "connect.com"),
        ("user[at]host[dot]org", "user@host.org"),
        ("a[:]b", "a:b"),
        (None, ""),
    ],
)
def test_refang(spark, raw, wanted):
    assert spark.createDataFrame([(raw,)], "t string").select(text.refang(F.col("t"))).first()[0] == wanted


def test_white_space_is_unicode(spark):
    assert one(spark, text.collapse(F.col("t")), t=" a\u00a0\u3000b\x1cc\n") == "a b c"
    assert one(spark, text.strip(F.col("t")), t="\u2003x y\u00a0") == "x y"


def test_clean_and_placeholder(spark):
    assert one(spark, text.clean(F.col("t")), t=" 'http://a.b/). ") == "http://a.b/"
    assert one(spark, text.has_placeholder(F.col("t")), t="a[REDACTED]b")
    assert one(spark, text.is_masked(text.blocks(F.col("t")), F.lit(4), F.lit(7)), t="ab* x.y")


def test_places_in_long_texts(spark):
    t = "ab🎉é" * 1000
    for s, e in [(0, 5), (1020, 1030), (3990, 4000), (0, 0), (1024, 2048), (2047, 2049), (3999, 4005)]:
        assert one(spark, text.cut(text.blocks(F.col("t")), F.lit(s), F.lit(e)), t=t) == t[s:e]
    for values in ([], [3], [1, 5, 2, 7, 1]):
        rows = spark.createDataFrame([(values,)], "v array<int>")
        got = rows.select(text.scan(F.col("v"), lambda a, b: a + b).alias("sum"), text.scan(F.col("v"), F.greatest).alias("max")).first()
        assert got.sum == [sum(values[: k + 1]) for k in range(len(values))] and got.max == [max(values[: k + 1]) for k in range(len(values))]


def test_even_spaces_do_not_change_contexts(spark):
    texts = ["a b c", " a b ", "a  b", "a\tb c", "a\x1fb", "x\u00a0y z", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    even, pieces = text.even(F.col("t")), text.blocks(F.col("t"))
    got = rows.select(even.alias("even"), *[text.context(pieces, F.lit(1), F.lit(2), 3, e).alias(n) for n, e in (("a", even), ("b", None))]).collect()
    assert [r.even for r in got] == [True, True, False, False, False, False, True, True]
    assert all(r.a == r.b for r in got)


def test_many_matches(spark):
    t = "é x1 " * 50_000
    got = spark.createDataFrame([(t,)], "t string").select(F.explode(text.matches(F.col("t"), "[a-z][0-9]")).alias("m")).agg(F.count("m"), F.max("m.start")).first()
    assert tuple(got) == (50_000, 5 * 49_999 + 2)


def brute_chunks(s, most, overlap):
    s = " ".join(s.split())
    if len(s) <= most:
        return [s] if s else []
    out, start = [], 0
    while True:
        end = min(len(s), start + most)
        if s[start:end].strip():
            out.append(s[start:end].strip())
        if end == len(s):
            return out
        start = end - overlap


@pytest.mark.parametrize("n", [0, 1, 10, 11, 12, 17, 18, 24, 25, 100])
def test_chunks_equal_a_loop(spark, n):
    s = "".join("ab c"[i % 4] for i in range(n))
    got = one(spark, text.chunks(F.col("t"), 10, 3), t=s)
    assert [c.text for c in got] == brute_chunks(s, 10, 3)
    assert [c.chunk_index for c in got] == list(range(1, len(got) + 1))


def test_chunks_of_a_long_text(spark):
    assert len(one(spark, text.chunks(F.col("t")), t="x" * 2500)) == 3
    with pytest.raises(ValueError, match="overlap"):
        text.chunks(F.col("t"), 10, 10)


def test_matches_see_what_is_around(spark):
    ip = r"(?U)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
    got = one(spark, text.matches(F.col("t"), ip), t="1.2.3.4.5 and 1.2.3.4, 80.85.157.3N/A")
    assert [(m.start, m.end, m.value) for m in got] == [(14, 21, "1.2.3.4"), (23, 34, "80.85.157.3")]


@pytest.mark.parametrize(
    ("ip", "public"),
    [("10.0.0.1", False), ("3.228.54.173", True), ("999.1.1.1", False), ("08.8.8.8", False), ("224.0.0.1", False), ("100.64.0.1", True), ("192.0.0.9", True), ("192.0.0.1", False), ("192.88.99.1", True), ("", False), ("1.2.3", False)],
)
def test_public_addresses(spark, ip, public):
    assert one(spark, net.is_public_ipv4(F.col("t")), t=ip) is public


def test_urls(spark):
    got = one(spark, net.split_urls(F.col("t")), t="http://a.com/xhttp://b.com/y")
    assert got == ["http://a.com/x", "http://b.com/y"]
    assert one(spark, net.url_host(F.col("t")), t="ftp://h.example:21/x:y") == "h.example"
    assert one(spark, net.port_for(F.lit("203.0.114.9"), F.col("t")), t="1.1.1.1:1, 203.0.114.9：8080") == "8080"


def test_registered_domains(spark):
    wanted = [("a.b.example.com", "example.com"), ("a.example.co.uk", "example.co.uk"), ("co.uk", ""), ("internal.lan", ""), ("x.y.ck", "x.y.ck"), ("www.ck", "www.ck"), ("8.8.8.8", ""), ("", ""), ("A.Example.ORG.", "example.org"), ("localhost", "")]
    got = net.with_registered_domain(spark.createDataFrame(wanted, "host string, wanted string"), "host", net.suffix_rules(spark)).collect()
    assert {r.host: r.domain for r in got} == dict(wanted)


def test_labels(spark):
    for raw in ("['T1059', 't1105']", "T1059, T1105", '["t1105", "T1059", "T1059"]'):
        assert one(spark, text.label_set(F.col("t")), t=raw) == ["T1059", "T1105"]
    assert one(spark, text.label_set(F.col("t")), t="[]") == []


def test_ids_and_slugs(spark):
    report = "360_APT-C-56-TransparentTribe-camouflage-campaign(03-13-2023)"
    got = spark.createDataFrame([(report, ["23.254.119.234"])], "r string, v array<string>").select(text.stable_id(F.col("r"), F.lit("ipv4"), F.col("v")), text.slug(F.col("r"))).first()
    assert tuple(got) == ("0f653f0b-135a-ac53-922e-874cb7c3a9db", "360-apt-c-56-transparenttribe-camouflage-campaign-03-13-2023")
    assert one(spark, text.slug(F.col("t")), t="--!") == "cti-report"


def test_yaml_scalars(spark):
    for raw, wanted in [("a b", '"a b"'), ("", '""'), ("007", "007"), ("true", "true"), ('q"\\', '"q\\"\\\\"'), ("ü", '"ü"'), ("a/b@c", "a/b@c"), ("x\n", '"x\\n"')]:
        assert one(spark, yaml.scalar(F.col("t")), t=raw) == wanted


def test_yaml_of_any_shape(spark):
    raw = '{"a": {"b": ["x", {"c": "d e"}]}, "n": 1, "t": true, "z": null, "l": []}'
    assert one(spark, yaml.from_json_text("t"), t=raw) == 'a:\n  b:\n    - x\n    -\n      c: "d e"\nn: 1\nt: true\nz: null\nl:\n'


def test_yaml_keys(spark):
    body = "title: x\ndetection:\n  sel:\n    condition: y\nlogsource:\n\n  product: w\n- item: z\nlevel: low"
    assert one(spark, yaml.top_level_keys(F.col("t")), t=body) == ["detection", "level", "logsource", "title"]
    assert one(spark, yaml.has_nested_key(F.col("t"), "detection", "condition"), t=body)
    assert one(spark, yaml.has_nested_key(F.col("t"), "logsource", "(?:category|product|service)"), t=body)
    assert not one(spark, yaml.has_nested_key(F.col("t"), "logsource", "condition"), t=body)


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="The C2 used a power-shell_x 10.5 and x") == ["c2", "power-shell_x", "10.5"]
    assert math.isclose(one(spark, F.log(F.col("t")), t=math.e), 1.0)
