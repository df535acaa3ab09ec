"""Each operator against a brute-force version on small tables, edge cases included."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from reportloom.llm import boosting, components, line_dedup, mixing, order_minhash, pii, quality_classifier, quality_rules, sentence_pieces, simhash, suffix_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " ", "\n\n", "x", "word " * 3000, "é" * 300, "\u00a0\u3000\u2028", "a\x00b", "漢字かな" * 50, "🎉" * 40]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, ids=None, source="s"):
    rows = [(i, t, "en", source, None, 7, "k") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    # columns that clash with what operators add
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, fp string")


@pytest.fixture(scope="module")
def mixed(spark):
    texts = [*EDGE, words(120, 1), words(120, 1), words(120, 1) + " end", words(80, 2), "same\nline here\nagain now\nmore text\nlast one\n" * 3]
    ids = [*range(len(texts) - 2), len(texts) - 3, None]
    texts[-3] = texts[-4]
    return table(spark, texts, ids).cache()


def by_row(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


CLASHES = [
    "host", "score", "ids", "exact", "base", "spans", "secrets", "n_spans", "n_bytes", "n_removed", "n_lines", "n_words", "host_rate", "host_trust", "base_failed", "slot", "epoch", "first", "upto", "size", "mark", "sid",
    "words", "node", "component", "component_id", "part", "key", "h1", "u", "v", "rank", "target", "taken", "verdict", "rule", "path", "block_score", "decoded", "n_tokens", "held_out", "predicted", "stats",
    "__id", "__mark", "__found", "__part", "__cut", "__host", "__spans", "__f", "__key",
]


def clashing(spark, texts):
    rows = table(spark, texts)
    return rows.withColumns({c: F.lit("clash") for c in CLASHES if c not in rows.columns})


@pytest.mark.parametrize(
    "run",
    [
        lambda d: quality_rules.judge(d),
        lambda d: line_dedup.dedup(d),
        lambda d: sentence_pieces.encode(d, check=True),
        lambda d: sentence_pieces.decode(sentence_pieces.encode(d)),
        lambda d: quality_classifier.classify(d, d.select("doc_id", F.lit(1).alias("quality"))),
        lambda d: url_filter.judge(d.withColumn("url", F.concat(F.lit("http://a.com/fr/"), F.col("doc_id").cast("string")))),
        lambda d: order_minhash.neighbours(d),
        lambda d: mixing.report(d),
        lambda d: mixing.blocks(d),
        lambda d: mixing.apply(d),
        lambda d: suffix_dedup.remove(d),
        lambda d: pii.find(d),
        lambda d: simhash.groups(d),
        lambda d: simhash.one_of_each(d),
    ],
)
def test_clashing_names(spark, run):
    """Inputs with columns named like everything that is added, or used on the way, give the rows that bare ones give."""
    texts = [words(40, 1), words(40, 1), words(40, 2) + " a@b.cd", None, ""]
    full, bare = run(clashing(spark, texts)), run(table(spark, texts))
    assert full.count() == bare.count()
    own = [c for c in bare.columns if c != "fp" or "fp" in full.columns]
    assert by_row(full.select(*own)) == by_row(bare.select(*own))


# ---- quality rules -------------------------------------------------------------------------------------------


def rules_of(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            cover |= set(range(i, i + 5))
    lines = (t or "").split("\n")
    dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


@pytest.mark.parametrize("seed", range(6))
def test_counts_of_rules(seed):
    r = random.Random(seed)
    t = "".join(r.choice(["a", "b", " ", "\n", "#", "|", "é", "\u00a0"]) for _ in range(400))
    assert quality_rules.measure_text(t.encode()) == rules_of(t)


def test_rules_of_edge_cases(spark, mixed):
    got = quality_rules.judge(mixed, keep_text=True)
    rows = got.collect()
    assert len(rows) == mixed.count()
    for r in rows:
        n, *_, repeats = rules_of(r.text) if len(r.text or "") < 5000 else (3000, 0, 0, 0, 3000)
        assert r.n_words == n and r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(mixed.limit(0), keep_text=False).count() == 0


def test_hosts_differ_by_their_shrunk_rates(spark):
    """Borderline documents go or stay by host alone; small hosts lean on the corpus."""
    clean, mild = words(60, 3, 10**6), words(60, 3, 10**6) + " #######"
    odd = words(60, 3, 10**6) + " ###########"
    hosts = {"good": (400, 8), "plain": (400, 40), "poor": (400, 90), "tiny": (2, 0)}
    rows = [(f"{odd} {h}{k}" if k < bad else f"{clean} {h}{k}", h) for h, (n, bad) in hosts.items() for k in range(n)]
    rows += [(t, h) for h in hosts for t in (mild, odd)]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = quality_rules.judge(docs).orderBy("doc_id").collect()
    rate = {r.source: r.host_rate for r in got}
    overall = sum(r.n_failures > 0 for r in got) / len(got)
    assert rate["good"] < rate["plain"] < rate["poor"] and abs(rate["tiny"] - overall) < abs(1 / 2 - overall)
    trust = {r.source: r.host_trust for r in got}
    assert (trust["good"], trust["poor"]) == (1, -1)
    last = {(r.source, r.text): r.kept for r in got[-8:]}
    assert [last[h, odd] for h in ("good", "poor")] == [True, False]
    assert [last[h, mild] for h in ("good", "poor")] == [True, False]
    assert all(r.kept for r in got if r.n_failures == 0)


def test_hosts_decide_on_single_failures(spark):
    clean = words(60, 3, 10**6)
    odd = clean + " ###########"
    rows = [(f"{clean} {i}", "good") for i in range(99)] + [(odd, "good")] + [(odd, "bad")] * 5 + [(f"{clean} b", "bad")]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {(r.source, "#" in r.text): r.kept for r in quality_rules.judge(docs).collect()}
    assert got == {("good", False): True, ("good", True): True, ("bad", True): False, ("bad", False): True}


# ---- line dedup ----------------------------------------------------------------------------------------------


def lines_of(rows):
    seen, out = {}, []
    for doc, t in rows:
        if t is None:
            out.append(None)
            continue
        kept = []
        for start, n, chunk in line_dedup.chunks(t.encode()):
            if n > 1 and line_dedup.eligible(chunk) and seen.setdefault(chunk, (doc, start)) != (doc, start):
                continue
            kept.append(chunk)
        out.append(b"\n".join(kept).decode())
    return out


def ends_of(lines):
    """After which lines chunks end, by the rule that after a run of lines that might end one, every second one does."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in lines]
    might = [((h[i - 1] % 2147483647 if i else 0) * 1_000_003 + h[i]) % 2147483647 % 2 == 0 for i in range(len(h))]
    out, i = [], 0
    while i < len(h):
        k = i
        while k < len(h) and might[k]:
            k += 1
        out += range(i + (i == 0), k, 2)
        i = k + 1
    return sorted({*out, len(h) - 1})


@pytest.mark.parametrize("seed", range(5))
def test_boundaries(seed):
    r = random.Random(seed)
    lines = ["".join(r.choice("abé ") for _ in range(r.randrange(4))) for _ in range(300)]
    got = line_dedup.chunks("\n".join(lines).encode())
    assert [s + n - 1 for s, n, _ in got] == ends_of(lines)
    assert b"\n".join(c for *_, c in got) == "\n".join(lines).encode()


def test_line_dedup(spark):
    r = random.Random(5)
    passage = "\n".join(words(8, k) for k in range(12))
    texts = ["\n".join([words(6, 100 + k), passage if k % 2 else words(30, k), words(5, 200 + k)]) for k in range(12)]
    texts += [texts[3], *EDGE, passage + "\n" + passage, "\n" * 20, "\n".join(r.choice("ab") for _ in range(200))]
    got = line_dedup.dedup(table(spark, texts)).orderBy("doc_id").collect()
    assert [x.text for x in got] == lines_of(list(enumerate(texts)))
    assert sum(x.n_removed for x in got) > 50
    shifted = line_dedup.chunks(("new line\n" + passage).encode())
    assert len({c for *_, c in shifted} & {c for *_, c in line_dedup.chunks(passage.encode())}) >= 2


def test_line_dedup_of_paragraphs_between_blank_lines(spark):
    paragraphs = [words(30, k, 10**6) for k in range(40)]
    texts = ["\n\n".join([words(20, 1000 + k, 10**6), *paragraphs, words(20, 2000 + k, 10**6)]) for k in range(3)] + ["\n" * 40] * 2
    seen, want = set(), []
    for t in texts:
        cut = [c for _, n, c in line_dedup.chunks(t.encode())]
        want.append(b"\n".join(c for c in cut if not (b"\n" in c and c.split() and c in seen)).decode())
        seen |= set(cut)
    got = line_dedup.dedup(table(spark, texts)).orderBy("doc_id").collect()
    assert [x.text for x in got] == want
    assert all(sum(p in x.text for p in paragraphs) <= 4 for x in got[1:3])
    assert [x.n_removed for x in got[3:]] == [0, 0]


def test_line_dedup_of_repeated_rows(spark, mixed):
    got = line_dedup.dedup(mixed)
    assert got.count() == mixed.count()
    assert line_dedup.dedup(mixed.limit(0)).count() == 0
    usual = by_row(got)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "MOST_BROADCAST", -1)
        assert by_row(line_dedup.dedup(mixed)) == usual
    twice = table(spark, ["a b\nc d\ne f\ng h"] * 2, [1, 1])
    assert {r.n_removed for r in line_dedup.dedup(twice).collect()} == {0}


# ---- SentencePiece -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.load()


def best(table, unit):
    """Viterbi by the definition: every substring looked up by itself."""
    score = {int(i): s for i, s in zip(table.ids, table.scores, strict=True)}
    spelled = {table.bytes[table.starts[i] : table.starts[i] + table.sizes[i]].tobytes().decode(): int(i) for i in table.ids}
    total, back = [np.float32(0)], [None]
    for e in range(1, len(unit) + 1):
        top = (np.float32(-np.inf), None)
        for s in range(max(0, e - table.longest), e):
            i = spelled.get(unit[s:e])
            v = total[s] + (score[i] if i is not None else table.unknown_score if e - s == 1 else np.float32(-np.inf))
            if v > top[0]:
                top = (v, (s, i))
        total.append(top[0])
        back.append(top[1])
    out, e = [], len(unit)
    while e:
        s, i = back[e]
        out = ([i] if i is not None else table.spelled(ord(unit[s]))) + out
        e = s
    return out


def test_search_equals_brute_force(pieces):
    units = [" hello", " the", " internationalization", "  spaced", "Thntblere", " ñandú", " 漢字", "🎉🎉", " a\x00b", "x" * 97, " " + "abc" * 40, " "]
    assert sentence_pieces.encode_units(pieces, units) == [best(pieces, u) for u in units]


@pytest.mark.parametrize("step", [1, 7, 16, 1000])
def test_long_units_in_steps(pieces, step, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "STEP", step)
    r = random.Random(step)
    for n in (1, 5, 60, 200):
        u = " " + "".join(r.choice(["the", "ing", "a", "é", "漢", "🎉", "tion", "x"]) for _ in range(n))
        assert sentence_pieces._search_long(pieces, np.frombuffer(u.encode("utf-32-le"), np.uint32)) == best(pieces, u)


def test_search_equals_the_library(pieces):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(sentence_pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces, searched rather than merged
    for i, s in zip(pieces.ids.tolist(), pieces.scores.tolist(), strict=True):
        model.pieces[i].score = s
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    units = sorted({w for k in range(3) for w in re.findall(r"\S+", words(200, k) + " Ouauon thanon éauxvi schpfgege ciónosta")})
    assert sentence_pieces.encode_units(pieces, [f" {u}" for u in units]) == library.encode(units)


def test_round_trip(spark, mixed):
    texts = [*EDGE, "▁x a▁b", "  two  spaces ", "tab\tand\r\nlines\n", words(500, 9), "\n"]
    docs = table(spark, texts)
    coded = sentence_pieces.encode(docs, check=True)
    got = sentence_pieces.decode(coded).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == texts and all(r.exact for r in got)
    assert [r.n_tokens for r in got][:2] == [0, 0] and got[0].ids is None and got[1].ids == []
    assert sentence_pieces.encode(mixed.limit(0)).count() == 0


# ---- quality classifier --------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    texts = [words(60, k, 10**6) if k % 4 else "BUY!! " * 20 + "### $$$ " * 10 for k in range(600)]
    docs = table(spark, [*texts, *EDGE])
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(600)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == len(texts) + len(EDGE)
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got.values())
    assert len(held) > 80 and all(r.predicted == (r.doc_id % 4 != 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    none = quality_classifier.classify(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(none) == (0.5, 0.5)
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, quality_classifier.STATISTICS))
    z = quality_classifier.expand(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, 1 + x.shape[1] :]
    squared = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-squared / (4 * x.shape[1]))).max() < 0.25


def test_classifier_equals_a_plain_one(spark):
    """The same scores from all rows at once: ridge by definition for each fold left out, isotonic by its max-min formula."""
    r = random.Random(8)
    texts = [words(r.randrange(5, 60), k) + " !" * (k % 5) + " #" * r.randrange(4) for k in range(300)]
    y_of = {k: int((k % 5 < 2) ^ (r.random() < 0.15)) for k in range(300)}
    labels = spark.createDataFrame(list(y_of.items()), "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality_classifier.classify(table(spark, texts), labels).collect()}
    rest = [zlib.crc32(str(k).encode()) % 5 for k in range(300)]
    stats = np.array([quality_classifier.statistics(t.encode()) for t in texts])
    own = np.array([k for k in range(300) if rest[k]])
    mean, scale = stats[own].mean(axis=0), stats[own].std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    z, y, fold = quality_classifier.expand(stats, mean, scale), np.array([y_of[k] for k in range(300)], float), np.array(rest) - 1
    penalty = np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    solve = lambda rows: np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ y[rows])
    left = np.array([z[k] @ solve(own[fold[own] != fold[k]]) for k in own])
    order = np.argsort(left, kind="stable")
    sorted_y, n = y[own][order], len(own)
    sums = np.concatenate(([0], np.cumsum(sorted_y)))
    curve = [max(min((sums[b] - sums[a]) / (b - a) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
    ats, values = [], []
    for v in sorted(set(np.round(curve, 12))):
        members = [left[order[i]] for i in range(n) if round(curve[i], 12) == v]
        ats.append(np.mean(members))
        values.append(v)
    raw = z @ solve(own)
    want = np.clip((1 - quality_classifier.ORDER) * np.interp(raw, ats, values) + quality_classifier.ORDER / (1 + np.exp(-np.clip(8 * (raw - 0.5), -50, 50))), 0, 1)
    assert np.abs(np.array([got[k] for k in range(300)]) - want).max() < 1e-4


def test_held_out_labels_are_not_learned(spark):
    docs = table(spark, [words(30, k) for k in range(80)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.classify(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert np.allclose([r.score for r in a], [r.score for r in b])


def test_isotonic():
    x, y = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1])
    at, value = quality_classifier.isotonic(x, y)
    assert value.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [0.0, 1.5, 3.5]


# ---- url filter ----------------------------------------------------------------------------------------------


def url_of(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in url_filter.RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "://", "http://ORG/", "http://x.org", "http://example.org/es/1?a=b", "https://a.example.org/en/12#x", "ftp://A.COM/fr/É/?q", "http://net/", "http://notorg/x", "x\n://b.org/\n?", "http://a.com/de/", "http://É.org/", "a" * 5000 + "://x.com/fr/"]
    urls += [f"http://h{k % 7}.example.com/{'de' if k % 2 else 'fr'}/{k}" for k in range(300)] + ["http://h.example.net/de/1", "http://h.example.net/fr/1"]
    pages = spark.createDataFrame([(k, u, "v", "r") for k, u in enumerate(urls)], "page_id long, url string, verdict string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = url_of(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert [got[k].verdict for k in (len(urls) - 2, len(urls) - 1)] == ["block", "allow"]
    assert url_filter.judge(pages.limit(0)).count() == 0


def lexical(u, suffix, head):
    host, path, *_ = url_of(u)

    def entropy(s):
        return -sum((c := s.count(x) / len(s)) * np.log2(c) for x in set(s)) if s else 0.0

    labels, last = host.split("."), path.split("/")[-1]
    out = [len(u), len(host), len(path), len(re.findall("/[^/]", path)), len(labels), len(re.findall("[0-9]", u)) / max(1, len(u)), len(re.findall("[0-9-]", host)), len(re.findall("[?&][^=&?#]+=", u)), u.count("#"), len(last)]
    out += [bool(re.search(r"\.[a-z]{2,5}$", path)), path.endswith("/"), u.startswith("https"), entropy(host), entropy(path), len(labels[-1]), suffix, head]
    return [int(np.floor(float(x) * 1000 + 1e-9)) for x in out]


def test_trees_equal_plain_ones(spark):
    """Features, shares, trees and threshold of a small table, worked out by hand from the definitions."""
    r = random.Random(12)
    urls = sorted({f"http://h{r.randrange(6)}.d{r.randrange(5)}.com/{r.choice(['de', 'fr', 'x', 'y/z'])}/{r.randrange(400)}" for _ in range(500)})
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge(pages.withColumn("f", url_filter.fold_of(F.col("url")))).orderBy("page_id").collect()
    labelled = [(u, x.f, url_of(u)[3] == "block") for u, x in zip(urls, rows, strict=True) if url_of(u)[2]]
    overall = (sum(b for *_, b in labelled) + 1) / (len(labelled) + 2)
    suffix_of, head_of = lambda u: ".".join(url_of(u)[0].split(".")[-2:]), lambda u: (url_of(u)[1].split("/") + ["", ""])[1]

    def share(key, u, without):
        own = [b for v, f, b in labelled if key(v) == key(u) and f != without]
        return (sum(own) + 10 * overall) / (len(own) + 10) if any(key(v) == key(u) for v, *_ in labelled) else overall

    x = np.array(sorted((*lexical(u, share(suffix_of, u, f), share(head_of, u, f)), int(b), f) for u, f, b in labelled), np.int64)
    train, held = x[x[:, -1] > 0], x[x[:, -1] == 0]
    model = boosting.fit(train[:, :-2], train[:, -2].astype(float), 1.0 - train[:, -2], trees=30, depth=3, least=5.0)
    want = boosting.predict(model, np.array([lexical(u, share(suffix_of, u, None), share(head_of, u, None)) for u in urls]))
    assert np.abs(np.array([x.block_score for x in rows]) - want).max() < 1e-6
    score = boosting.predict(model, held[:, :-2])
    cuts = [c for c in set(score) if np.mean(held[score >= c, -2]) >= 0.9]
    least = max(0.5, min(cuts) - 1e-9) if cuts else 2.0
    assert [x.verdict for x in rows if x.rule is None] == ["block" if w >= least else "allow" for w, x in zip(want, rows, strict=True) if x.rule is None]


def test_own_labels_are_no_features(spark, monkeypatch):
    """Heads that occur once say nothing about their url: with its own label in its share the trees would look perfect."""
    r = random.Random(3)
    rules = [("allow", "com/a"), ("block", "com/b")]
    urls = [f"http://h.com/{'ab'[r.randrange(2)]}{k:04}/q" for k in range(400)] + [f"http://h.net/c{k:04}/q" for k in range(50)]
    seen, fit = [], url_filter._fit
    monkeypatch.setattr(url_filter, "_fit", lambda labelled, *rest: seen.append((labelled.select("__head").distinct().count(), fit(labelled, *rest))) or seen[-1][1])
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    assert seen[0][0] == 1 and seen[0][1][1] == 2.0
    assert {r.verdict for r in got if r.rule is None} == {"allow"}


@pytest.mark.parametrize("broadcast", [url_filter.MOST_BROADCAST, 0])
def test_all_suffixes_have_their_share(spark, broadcast, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", broadcast)
    rules = [("allow", "com/a/"), ("block", "com/a/x")]
    urls = [f"http://d{k:04}.com/a/{'x' if k % 2 else 'y'}{n}" for k in range(800) for n in range(4)] + [f"http://d{k:04}.com/z/q1" for k in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, rules=rules).filter("rule is null").orderBy("page_id").collect()
    assert [r.verdict for r in got] == [("allow", "block")[k % 2] for k in range(800)]


def test_trees_as_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10, (300, 3))
    yes = ((x[:, 0] > 5) ^ (x[:, 1] > 3)).astype(float)
    model = boosting.fit(x, yes, 1 - yes, trees=20)
    want = boosting.predict(model, x)
    assert ((want > 0.5) == yes).mean() > 0.95
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int")
    got = rows.select(boosting.as_column(model, [F.col(c) for c in "abc"]).alias("p")).collect()
    assert np.allclose([r.p for r in got], want)


def test_trees_over_a_table(spark):
    """Two models at once, the second without a third of the rows, as fit() has them one by one."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (400, 3))
    yes = rng.integers(0, 5, (400, 2)) * ((x[:, :1] > 5) ^ (x[:, 1:2] > 3))
    no = rng.integers(0, 3, (400, 2))
    yes[:130, 1] = no[:130, 1] = 0
    cells = spark.createDataFrame([(*map(int, r), *map(int, y), *map(int, n)) for r, y, n in zip(x, yes, no, strict=True)], "a int, b int, c int, y0 long, y1 long, n0 long, n1 long")
    got = boosting.fit_table(cells, ["a", "b", "c"], [F.col("y0"), F.col("y1")], [F.col("n0"), F.col("n1")], trees=4)
    for k in range(2):
        use = yes[:, k] + no[:, k] > 0
        model = boosting.fit(x[use], yes[use, k].astype(float), no[use, k].astype(float), trees=4)
        assert len(got[k][1]) == len(model[1]) == 4
        assert np.allclose(boosting.predict(got[k], x), boosting.predict(model, x), atol=1e-5)
    empty = boosting.fit_table(cells.limit(0), ["a"], [F.col("y0")], [F.col("n0")])
    assert empty == [(0.0, [])]


# ---- order MinHash -------------------------------------------------------------------------------------------


def test_fingerprints_and_neighbours(spark):
    texts = [*EDGE, *[words(40 + k, k) for k in range(30)], words(50, 1), words(50, 1)]
    ids = [None, *range(1, len(texts))]
    got = order_minhash.neighbours(table(spark, texts, ids)).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    plain = [t or "" for t in texts]
    for k, r in enumerate(got):
        t, after = plain[k], plain[(k + 1) % len(plain)]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == order_minhash.likeness(order_minhash.sketch(t), order_minhash.sketch(edited))
        assert 0 <= r.near_next <= 1
    assert got[-1].fingerprint == got[-2].fingerprint and got[-2].near_next == 1
    assert order_minhash.neighbours(table(spark, ["solo text here"])).first().near_next == 1
    assert order_minhash.neighbours(table(spark, [])).count() == 0


def plain_sketch(t):
    """The fingerprint by its definition, one number at a time."""
    word, a, b = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def mix(x):
        x = (x ^ (x >> 32)) * b & word
        x = (x ^ (x >> 29)) * a & word
        return x ^ (x >> 32)

    if not t:
        return [0] * 64
    h = [mix(ord(c) + 1) for c in t]
    if len(h) < 8:
        whole = len(h)
        for x in h:
            whole = (whole * a + x) & word
        h = [mix(whole)]
    else:
        for width in (1, 2, 4):
            h = [(h[i] * a + mix((h[i + width] + width) & word)) & word for i in range(len(h) - width)]
        h = [mix(x) for x in h]
    bits = max(20, len(h).bit_length())
    before, items = {}, []
    for x in h:
        # occurrences are told apart by the leading bits
        n = before[x >> bits] = before.get(x >> bits, -1) + 1
        items.append((x, n))
    items = [mix(x) for x, _ in items] if all(n == 0 for _, n in items) else [mix((x + n * b) & word) for x, n in items]
    bits, out = max(20, len(items).bit_length()), []
    by_slot = {}
    for place, x in enumerate(items):
        by_slot.setdefault(x >> 58, []).append((x >> bits, place))
    for s in range(64):
        own = sorted(by_slot.get(s, []))
        if len(own) < 2:
            salt = int(order_minhash._SALTS[s])
            own = sorted((mix(x ^ salt), place) for place, x in enumerate(items))
        total = 0
        for place in sorted(p for _, p in own[:2]):
            total = mix((total * a + items[place]) & word)
        out.append(mix((total + 1) & word) >> 48)
    return out


@pytest.mark.parametrize("n", [1, 3, 7, 8, 9, 30, 200, 1500])
def test_fingerprints_equal_plain_ones(n):
    for seed in range(4):
        t = (words(400, seed, 30 if seed % 2 else 10**6) + "é🎉")[-n:]
        assert order_minhash.sketch(t).tolist() == plain_sketch(t)


def test_uneven_texts_are_dealt_by_bytes(spark):
    texts = ["x" * 200_000 if 40 <= k < 60 else words(5, k) for k in range(200)]
    rows = order_minhash.neighbours(table(spark, texts))
    got = {r.doc_id: r.edited_sha256 for r in rows.collect()}
    for k in range(200):
        t, after = texts[k], texts[(k + 1) % 200]
        m = len(t) // 4
        assert got[k] == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
    sizes = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(x["count"] for x in sizes) < 200


def test_signatures_follow_edits():
    t = words(400, 3, 10**6)
    s, order = order_minhash.sketch(t), order_minhash.likeness
    near = [order(s, order_minhash.sketch(t[: len(t) - n] + words(400, 4, 10**6)[:n])) for n in (0, 50, 300, 1200)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[-1] > 0.2
    half = len(t) // 2
    chopped = "".join(t[k : k + 20] for k in sorted(range(0, len(t), 20), key=lambda k: -k))
    assert order(s, order_minhash.sketch(t[half:] + t[:half])) > order(s, order_minhash.sketch(chopped))


# ---- mixing --------------------------------------------------------------------------------------------------


def water(sizes):
    """source -> target by filling up step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)


def test_mixing(spark):
    r = random.Random(1)
    rows = [(k, words(r.choice([0, 1, 5, 50, 700]), k), r.choice(["a", "b", "c", "Z", "é", None])) for k in range(150)]
    rows += [(k, words(3, k), "tiny") for k in range(150, 153)] + [(200, "x y", "b"), (200, "x y", "b"), (None, "n u l l", "a"), (None, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = water(sizes)
    for s in sizes:
        own = [g for g in got if g.source == s]
        assert all(abs(g.target - want[s]) < 1e-6 and g.source_size == sizes[s] for g in own)
        assert abs(sum(g.taken for g in own) - want[s]) <= 1
    assert all(g.taken <= 3 * g.size for g in got)
    assert by_row(mixing.report(docs)) == sorted(map(str, (tuple(g) for g in got)))
    mixed = mixing.apply(docs).collect()
    assert sum(len(WORD.findall(m.text)) for m in mixed) == sum(g.taken for g in got)
    assert mixing.report(docs.limit(0)).count() == 0
    assert {g.taken for g in mixing.report(docs.filter("source = 'void'")).collect()} == {0}


def mix_of(rows, golden=mixing.GOLDEN, block=256):
    """(doc_id, taken, first slot, slots) of each document, by walking through the schedule."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, own in rows if own == s) for s in sources}
    target = water(total)
    words_of = {s: min(int(np.floor(target[s] + 0.5)), 3 * total[s]) for s in sources}
    blocks = {s: -(-words_of[s] // block) for s in sources}
    upto, bounds = 0, []
    for s in sources:
        bounds.append((s, upto * 10**18 // sum(words_of.values()), (upto + words_of[s]) * 10**18 // sum(words_of.values())))
        upto += words_of[s]
    slots = {s: [] for s in sources}
    for k in range(sum(blocks.values())):
        u = (k + 1) * golden % 10**18
        s = next(s for s, lo, hi in bounds if lo <= u < hi)
        if len(slots[s]) < blocks[s]:
            slots[s].append(k)
    for n, s in enumerate(sources):
        slots[s] += [sum(blocks.values()) + rank * len(sources) + n for rank in range(len(slots[s]), blocks[s])]
    out = {}
    for s in sources:
        line = sorted((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), i) for i, _, own in rows if own == s)
        at, used = 0, {}
        for _ in range(3):
            for _, i in line:
                for w in range(at, min(at + size[i], words_of[s])):
                    used.setdefault(i, []).append(w // block)
                at += size[i]
        for _, i in line:
            ranks = used.get(i, [])
            # a block counts again for each time round
            pieces = sum(1 for k, x in enumerate(ranks) if k == 0 or x != ranks[k - 1] or k % size[i] == 0)
            out[i] = (len(ranks), min((slots[s][x] for x in ranks), default=None), pieces)
    return out


@pytest.mark.parametrize("golden", [mixing.GOLDEN, 381966011250105151])
def test_mix_equals_a_walk_through_the_schedule(spark, golden):
    r = random.Random(21)
    rows = [(k, words(r.choice([0, 3, 40, 300, 900]), k), r.choice(["a", "b", "b", "c", "é", None])) for k in range(90)] + [(90, "few words", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: (x.taken, x.first_slot, x.n_slots) for x in mixing.report(docs, golden=golden).collect()}
    assert got == mix_of(rows, golden)


def test_mix_depends_on_the_points(spark):
    docs = spark.createDataFrame([(k, words(200, k), f"s{k % 4}") for k in range(60)], "doc_id long, text string, source string")
    a, b = (sorted((x.doc_id, x.first_slot) for x in mixing.report(docs, golden=g).collect()) for g in (mixing.GOLDEN, 10**17))
    assert a != b


def test_blocks_are_the_mix(spark):
    r = random.Random(22)
    rows = [(k, words(r.choice([0, 10, 300, 700]), k, 10**6), r.choice(["a", "b", "c"]), "en") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    blocks, whole = mixing.blocks(docs).collect(), mixing.apply(docs).collect()
    slots = [b.slot for b in blocks]
    assert slots == sorted(slots) and [w.slot for w in whole] == sorted(w.slot for w in whole)
    text = {k: t.split() for k, t, *_ in rows}
    assert all(b.text.split() == text[b.doc_id][b.first : b.upto] and b.lang == "en" for b in blocks)
    sizes = {}
    for b in blocks:
        sizes[b.slot] = sizes.get(b.slot, 0) + b.upto - b.first
    assert sum(n != mixing.BLOCK for n in sizes.values()) <= 3 and max(sizes.values()) == mixing.BLOCK
    assert sum(sizes.values()) == sum(len(w.text.split()) for w in whole)
    first = {}
    for b in blocks:
        first.setdefault((b.doc_id, b.epoch), b.slot)
    assert sorted((d, s) for (d, _), s in first.items()) == sorted((w.doc_id, w.slot) for w in whole)


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(1, 6000, 1000.0), (2, 6000, 2000.0), (3, 6000, 3000.0)], "sid int, source_size long, target double")
    slots = [r.sid for r in mixing.schedule(sources, 10).orderBy("slot").collect()]
    assert [slots.count(k) for k in (1, 2, 3)] == [100, 200, 300]
    for k in range(0, 540, 60):
        assert abs(slots[k : k + 60].count(3) - 30) <= 3


# ---- suffix-array dedup --------------------------------------------------------------------------------------


def spans_of(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = [False] * len(b)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                cover[i : i + length] = [True] * length
            seen.add(b[i : i + length])
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 200])
def test_suffix_dedup(spark, block):
    shared = words(60, 77)
    texts = [*EDGE, *[words(10, k) + " " + shared[k : 200 + 7 * k] + words(8, 50 + k) for k in range(12)], shared, shared, "ab" * 400, words(90, 5) + words(90, 5), "é" * 120 + "x"]
    docs = table(spark, texts)
    got = suffix_dedup.remove(docs, block=block).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == spans_of(texts, 100)
    assert sum(r.n_removed for r in got) > 3000


@pytest.mark.parametrize("levels", [0, 1, 4])
def test_large_anchors_are_split(spark, levels, monkeypatch):
    """Many different texts around one phrase: more segments of its anchor than a block."""
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    phrase = "the very same phrase of forty and so characters stands here"
    texts = [words(12, k) + phrase + words(12, 300 + k % 7) for k in range(60)] + ["ab" * 300, "x" * 500, words(12, 3) + phrase + words(12, 302)]
    got = suffix_dedup.remove(table(spark, texts), block=600).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == spans_of(texts, 100)


def test_suffix_dedup_of_repeated_rows(spark):
    t = words(60, 1)
    got = suffix_dedup.remove(table(spark, [t, t, t, words(60, 2)], [1, 1, None, 1]), keep_text=False)
    assert sorted((r.doc_id or 0, r.n_removed == len(t)) for r in got.collect()) == [(0, False), (1, False), (1, True), (1, True)]
    assert suffix_dedup.remove(table(spark, [])).count() == 0


@pytest.mark.parametrize("length", [3, 6])
def test_interval_expansion(length):
    rng = np.random.default_rng(length)
    for _ in range(20):
        segments = [bytes(rng.integers(97, 99, rng.integers(length, 25)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        n = [len(s) - length + 1 for s in segments]
        rank = rng.permutation(sum(n))
        first, all_ = {}, []
        for k, s in enumerate(segments):
            for i in range(n[k]):
                all_.append((k, i, s[i : i + length], rank[len(all_)]))
        for *_, b, r in all_:
            first[b] = min(first.get(b, r), r)
        assert set(suffix_dedup.repeated_windows(segments, n, rank, length)) == {(k, i) for k, i, b, r in all_ if r > first[b]}


# ---- personal data -------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_of(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark):
    r = random.Random(2)
    texts = [*EDGE, "a@b.c_d@e.f g@h..i j@k.l. m@-.-", "1.2.3.4.5.6.7.8 010.1.1.1 256.1.1.1", "+1 (988) 555-2485 +49..--12 x+123456789)", "4111 1111 1111 1111, 4111-1111-1111-1112", "é 🎉 q@w.e", "9" * 6000, "a." * 3000 + "@", "x@" + "a." * 3000 + "b", "1 " * 4000]
    texts += ["".join(r.choice("ab1234567890.@+-() _é") for _ in range(300)) for _ in range(60)]
    docs = table(spark, texts)
    got = pii.find(docs).orderBy("doc_id").collect()
    for t, row in zip(texts, got, strict=True):
        want = base_of(t)
        assert [tuple(s) for s in row.base] == want, t
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(1 for w in want if w[1] == k) for k in range(4)]
        assert set(want) <= {tuple(s) for s in row.spans}
    assert pii.find(docs.limit(0)).count() == 0


def test_places_of_candidates(spark):
    """Guards look at what is around, so the first occurrence of a match's characters need not be the match."""
    texts = ["a +030 123 4567 and then 030 123 4567 end", "1.1234.1234.1234.1234 then 4111.1111.1111.1111 x", "x@y then x@y\n", "é🎉 2001:db8::1, 12:30:45", "\x01+1 (415) 555-2671 4736962573099581"]
    texts += [" ".join(random.Random(k).choice(["a@b", "030 123 4567", "+030 123 4567", "4111.1111.1111.1111", "1.4111.1111.1111.1111", "é", "j (at) k (dot) org", "1::2"]) for _ in range(12)) for k in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, sign, pattern in pii.GENERATORS:
        got = [r[0] for r in rows.select(pii.places(F.translate("t", "\x01", "\x02"), pattern, sign)).collect()]
        # Python knows possessive quantifiers too
        for t, found in zip(texts, got, strict=True):
            assert [(m.s, m.e) for m in found] == [m.span() for m in re.finditer(pattern, t.replace("\x01", "\x02"))], (kind, t)
            assert all(t.replace("\x01", "\x02")[m.s : m.e] == m.m and t.replace("\x01", "\x02")[: m.s].endswith(m.before) for m in found)


def test_candidates_are_added(spark):
    r = random.Random(3)

    def number():
        return f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"

    texts = [f"call me at +1 {number()} now, order {r.randrange(10**5)}, host 10.{k % 256}.3.4, mail u{k}@h{k}.org" for k in range(200)]
    wanted = ["(415) 555-0101", "jane.doe (at) example (dot) org", "2001:db8:0:0:0:0:2:1", "+1 (415) 555-2671", 'api_key = "9b0b3c6a43eb78aa99cb']
    texts += [f"call me at {wanted[0]} now", f"mail {wanted[1]} now", f"host {wanted[2]} now", f"call {wanted[3]} 4736962573099581 x", f'env {wanted[4]}" now', "at 12:30 on 5-6, version 4.0 of 1999"]
    got = pii.find(table(spark, texts)).orderBy("doc_id").collect()
    assert all([tuple(s) for s in x.base] == [tuple(s) for s in x.spans] and len(x.base) == 3 for x in got[:200])
    more = [[texts[200 + k][s:e] for s, _, e in [*x.spans, *x.secrets] if (s, _, e) not in {tuple(b) for b in x.base}] for k, x in enumerate(got[200:])]
    assert more == [[w] for w in wanted] + [[]]
    assert [x.n_spans for x in got[200:]] == [1, 1, 1, 1, 1, 0]
    clean = pii.find(table(spark, ["nothing here", "version 4.0 of 1999"])).collect()
    assert not any(x.spans for x in clean)


def test_checks_are_not_learned(spark):
    """Numbers that fail their check look like those that pass: no threshold lets such a candidate through."""
    r = random.Random(9)

    def card(good):
        body = "".join(r.choice("0123456789") for _ in range(15))
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if good else str((int(last) + 1 + r.randrange(9)) % 10))

    texts = [f"a {card(k % 2)} b" for k in range(300)] + ["pay 4111.1111.1111.1111 now"]
    got = pii.find(table(spark, texts)).orderBy("doc_id").collect()
    assert all(x.n_card == len(x.spans) == k % 2 for k, x in enumerate(got[:300])) and not got[300].spans


def test_thresholds_come_from_all_documents(spark):
    """One part's cards all pass, the others' seldom enough: over all documents no score is precise enough."""
    r = random.Random(10)
    cards = ["".join(r.choice("0123456789") for _ in range(16)) for _ in range(6000)]
    texts = [f"a {c} b" for c in cards]
    parts = [p for (p,) in spark.createDataFrame([(t,) for t in texts], "t string").select(F.pmod(F.xxhash64("t"), F.lit(4))).collect()]

    def some(part, good, n):
        return [t for t, c, p in zip(texts, cards, parts, strict=True) if (p == 0) == (part == 0) and luhn(c) == good][:n]

    texts = [*some(0, True, 80), *some(1, True, 150), *some(1, False, 100), "pay 4111.1111.1111.1111 now"]
    got = pii.find(table(spark, texts)).orderBy("doc_id").collect()
    assert [len(x.spans) for x in got] == [1] * 230 + [0] * 101


@pytest.mark.parametrize("on_driver", [True, False])
def test_all_combinations_of_features_count(spark, on_driver, monkeypatch):
    """50,000 combinations, of which the 30,000 seen once are wrong."""
    monkeypatch.setattr(pii, "features", lambda c: [c["kind"], *[F.floor(c["x"] / 20**k).cast("int") % 20 for k in range(4)], *[F.lit(0)] * 6])
    if not on_driver:
        monkeypatch.setattr(pii, "DRIVER_CELLS", 49_999)
        monkeypatch.setattr(pii, "TREES", pii.TREES | {"trees": 2})
    one = F.struct(F.lit(1).alias("kind"), (F.col("id") * 7919 % 160_000).alias("x"), (F.col("id") < 20_000).alias("ok"))
    rows = spark.range(50_000).select((F.col("id") % 4).alias("__part"), F.array_repeat(one, F.when(F.col("id") < 20_000, 2).otherwise(1)).alias("__found"))
    (start, _), limits = pii._train(rows)
    assert start == pytest.approx(np.log(40_000.5 / 30_000.5))
    # what the right ones alone would give
    assert min(limits) > 0.5


def test_thresholds_beyond_the_driver(spark, monkeypatch):
    """The same trees and thresholds where the combinations are too many for the driver."""
    r = random.Random(11)
    monkeypatch.setattr(pii, "features", lambda c: [c["kind"], *[F.get(c["f"], F.lit(k)) for k in range(10)]])
    monkeypatch.setattr(pii, "TREES", pii.TREES | {"trees": 5})
    rows = []
    for k in range(1500):
        kind, f = r.choice([0, 1, 2, 4]), [r.randrange(8) for _ in range(10)]
        rows.append((k % 4 if k < 1200 else 1, [(kind, f, kind == 4 or r.random() < (0.99 if f[kind] > 3 else 0.4))]))
    rows = spark.createDataFrame(rows, "__part int, __found array<struct<kind:int,f:array<int>,ok:boolean>>")
    model, limits = pii._train(rows)
    monkeypatch.setattr(pii, "DRIVER_CELLS", 0)
    over_table, same = pii._train(rows)
    assert same == pytest.approx(limits, abs=1e-5) and 0.5 < limits[0] < 1 and limits[3] == limits[4]
    x = np.array([[r.randrange(5), *[r.randrange(8) for _ in range(10)]] for _ in range(500)])
    assert np.allclose(boosting.predict(over_table, x), boosting.predict(model, x), atol=1e-5)
    # all in one part: no other has trees for it
    rows = rows.withColumn("__part", F.lit(2))
    alone = pii._train(rows)[1]
    monkeypatch.setattr(pii, "DRIVER_CELLS", 1500)
    assert alone == pytest.approx(pii._train(rows)[1], abs=1e-5)


def test_many_matches_in_one_text(spark):
    text = "ab@c.d, 10.0.0.1 +1 (415) 555-2671; " * 30_000
    began = time.time()
    row = pii.find(table(spark, [text])).select("n_email", "n_ip", "n_phone", F.md5(pii.redact(F.col("text"), F.col("spans")).cast("binary")).alias("r")).first()
    assert (row.n_email, row.n_ip, row.n_phone) == (30_000, 30_000, 30_000)
    assert row.r == hashlib.md5(("[email], [ip] [phone]; " * 30_000).encode()).hexdigest()
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(4))
def test_overlaps(spark, seed):
    r = random.Random(seed)
    spans = lambda n: [(s := r.randrange(60), r.randrange(4), s + 1 + r.randrange(6)) for _ in range(n)]
    base, added = sorted(spans(4)), [(s, e, k, r.randrange(50) / 100) for s, k, e in spans(15)]
    rows = spark.createDataFrame([(base, added)], "b array<struct<s:int,kind:int,e:int>>, a array<struct<s:int,e:int,kind:int,score:double>>")
    got = sorted(tuple(x) for x in rows.select(pii._apart(F.col("b"), F.col("a"))).first()[0])
    free, runs = sorted((s, e, k, p) for s, e, k, p in added if not any(x < e and s < y for x, _, y in base)), []
    for x in free:
        if runs and x[0] < max(y[1] for y in runs[-1]):
            runs[-1].append(x)
        else:
            runs.append([x])
    best = [min(run, key=lambda x: (-x[3], x[0], -x[1], x[2])) for run in runs]
    assert got == sorted((s, k, e) for s, e, k, _ in best)


def test_candidates_of_kinds_without_failures_are_added(spark):
    r = random.Random(4)
    texts = [f"mail user{k}@host{k}.org or call +1 {r.randrange(200, 999)} 555-{r.randrange(1000, 9999)} now" for k in range(100)]
    texts += ["mail jane.doe (at) example (dot) org today", "call me at (415) 555-0101 now", "none of this"]
    got = pii.find(table(spark, texts)).orderBy("doc_id").collect()
    spans = [[texts[k][s:e] for s, _, e in got[k].spans] for k in range(100, 103)]
    assert spans == [["jane.doe (at) example (dot) org"], ["(415) 555-0101"], []]
    assert all(len(x.spans) == 2 for x in got[:100])


def test_redaction(spark):
    rows = pii.find(table(spark, ["mail a@b.cd or +1 415 555 2671.", "none", None]))
    got = [r[0] for r in rows.orderBy("doc_id").select(pii.redact(F.coalesce("text", F.lit("")), F.col("spans"))).collect()]
    assert got == ["mail [email] or [phone].", "none", ""]


# ---- SimHash -------------------------------------------------------------------------------------------------


def test_fingerprints():
    for t in [x for x in EDGE if x is not None and len(x) < 400] + ["One two THREE Ünï four", words(30, 1)]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        w = WORD.findall(low)
        h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if w else 0
        assert simhash.fingerprint(t.encode()) == want


def test_masks_cover():
    masks = simhash.masks()
    r = random.Random(1)
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not m & flips for m in masks)
    assert {30 <= m.bit_count() <= 38 for m in masks} == {True}


def clusters(fps, radius=3):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links(spark, bucket):
    r = random.Random(4)
    fps = set()
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in r.sample(range(64), r.randrange(1, 4)):
                x ^= 1 << b
    fps = sorted(fps)
    rows = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    found = {n: c for n, c in components.connected_components(simhash.links(rows, bucket=bucket)).collect()}
    mine = {}
    for x in fps:
        mine.setdefault(found.get(simhash.signed(x), simhash.signed(x)), set()).add(x)
    want = {}
    for x, c in zip(fps, clusters(fps), strict=True):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_groups(spark, mixed):
    got = simhash.groups(mixed).collect()
    assert len(got) == mixed.count()
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {0}
    assert simhash.groups(mixed.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 4])
def test_one_of_each(spark, bucket, monkeypatch):
    base = [words(200, k, 10**6).split() for k in range(8)]
    texts = []
    for k, w in enumerate(base):
        for v in range(6):
            texts.append(" ".join([*w[: 20 * v], f"edit{v}", *w[20 * v + 1 :]]))
    texts += [texts[0], texts[0], *EDGE, *[words(100, 1000 + k, 10**6) for k in range(20)]]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    texts[-1] = texts[-2]
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (simhash.RADIUS, bucket))
    kept = sorted(r.doc_id for r in simhash.one_of_each(table(spark, texts, ids)).collect())
    assert kept[:8] == [6 * k for k in range(8)]
    assert len(kept) == len(set(kept)) and set(ids[-20:]) <= set(kept)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 4])
def test_equal_words_in_another_order_stay(spark, bucket, monkeypatch):
    w = words(120, 5, 10**6).split()
    texts = [" ".join(random.Random(k).sample(w, len(w))) for k in range(15)]
    texts += [f"{texts[3]} end", f"{texts[3]} end more", f"{texts[9]} other"]
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (simhash.RADIUS, bucket))
    kept = sorted(r.doc_id for r in simhash.one_of_each(table(spark, texts)).collect())
    assert kept == list(range(15))


def test_large_buckets_do_not_change_results(spark, monkeypatch):
    """Equal words in another order stay, alone and among so many others that their buckets are over the limit."""
    w = words(200, 5, 10**6).split()
    orders = [" ".join(random.Random(k).sample(w, len(w))) for k in range(12)]
    fillers = [" ".join(random.Random(100 + k).sample(w, len(w))) for k in range(300)]
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (simhash.RADIUS, 64))
    for texts in (orders, orders + fillers):
        kept = {r.doc_id for r in simhash.one_of_each(table(spark, texts)).select("doc_id").collect()}
        assert kept == set(range(len(texts)))


@pytest.mark.parametrize("most", [simhash.MOST_NODES, 5])
def test_large_groups_are_compared_clump_by_clump(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_NODES", most)
    base = [words(150, k, 10**6).split() for k in range(4)]
    texts = [" ".join([*w[: 9 * v], f"edit{v}", *w[9 * v + 1 :]]) for w in base for v in range(12)] + [words(90, 70 + k, 10**6) for k in range(10)]
    kept = sorted(r.doc_id for r in simhash.one_of_each(table(spark, texts)).select("doc_id").collect())
    assert kept == [0, 12, 24, 36, *range(48, 58)]


def exact_groups(texts, similarity=0.8):
    """label of each text by all pairs of shingle sets that are as similar."""
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    holders, label = {}, list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, own in enumerate(sets):
        common = {}
        for x in own:
            for j in holders.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            holders[x].append(k)
        for j, c in common.items():
            if c >= similarity * (len(own) + len(sets[j]) - c) - 1e-9:
                a, b = sorted((root(j), root(k)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def test_recall_of_near_copies(spark):
    """Texts of all lengths with copies from nearly equal to just similar enough, against all pairs."""
    r = random.Random(31)
    texts = []
    for k in range(120):
        w = words(r.choice([12, 40, 120, 400]), 3000 + k, 10**6).split()
        texts.append(" ".join(w))
        for _ in range(3):
            own = list(w)
            for _ in range(max(1, int(len(w) * r.choice([0.005, 0.01, 0.02, 0.025])))):
                own[r.randrange(len(own))] = f"e{r.randrange(10**9)}"
            texts.append(" ".join(own))
    want = exact_groups(texts)
    kept = {x.doc_id for x in simhash.one_of_each(table(spark, texts)).select("doc_id").collect()}
    gone = {k for k in range(len(texts)) if want[k] != k}
    assert len(gone) > 150
    assert len(gone - kept) >= 0.9 * len(gone)
    # whatever goes has a copy that stays
    assert {k for k in range(len(texts)) if k not in kept} <= gone


def test_near_copies_by_exact_shingles(spark):
    """Pairs just above and just below the similarity, which an estimate cannot tell apart."""
    texts, near = [], []
    for k in range(30):
        w = words(205, 500 + k, 10**6).split()
        # one changed word inside takes out five shingles on each side: 201 - 5 n of 201 + 5 n are common
        for n in (4, 5):
            texts += [" ".join(w), " ".join("new" + str(k * 10 + n) + str(i) if i % 40 == 9 and i // 40 < n else x for i, x in enumerate(w))]
            w = words(205, 900 + k, 10**6).split()
            near.append((201 - 5 * n) / (201 + 5 * n) >= 0.8)
    assert set(near) == {True, False}
    kept = {r.doc_id for r in simhash.one_of_each(table(spark, texts)).collect()}
    assert [2 * k + 1 not in kept for k in range(len(near))] == near


@pytest.mark.parametrize("seed", range(4))
def test_similar_pairs(seed):
    r = random.Random(seed)
    base = [r.sample(range(1000), 20) for _ in range(3)]
    sets = [np.array(sorted(set(x for x in r.choice(base) if r.random() < 0.93) | {r.randrange(1000)}), np.int64) for _ in range(40)] + [np.empty(0, np.int64)] * 2

    def labels(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    likeness = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    plain = [set(x.tolist()) for x in sets]
    want = [(a, b) for a in range(len(sets)) for b in range(a) if likeness(plain[a], plain[b])]
    assert labels(simhash.similar_pairs(sets, 0.8)) == labels(want)


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)]
    got = {n: c for n, c in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = label.get(a, a), label.get(b, b)
            label |= {n: min(x, y) for n, v in list(label.items()) if v in (x, y)} | {a: min(x, y), b: min(x, y)}
    assert got == label
    hub = spark.range(1, 5000).select(F.lit(7000).cast("long").alias("a"), F.col("id").alias("b"))
    assert {tuple(x) for x in components.connected_components(hub).agg(F.count("node"), F.max("component")).collect()} == {(5000, 1)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
