"""Secrets, urls and quality."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import oracle, quality_crf, quality_rules, queries, secret_scan, url_filter
from gaugework.llm.common import WordHasher
from gaugework.llm.logistic import calibrate, fit, sigmoid

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def spans_of(frame):
    return [
        (r["text"] or "", [(s["kind"], s["start"], s["end"]) for s in r["spans"]])
        for r in secret_scan.find_secrets(frame).select("text", "spans").collect()
    ]


def test_base_spans(spark, odd, none):
    key = hashlib.sha256(b"x").hexdigest()
    tricky = [
        f"é password='{key}' x", "token=secret=abcdefghijkl", 'password = "token: abcdefghijklmnop"', f"{key}{key} AKIA{'A1' * 9}AKIA",
        "API_KEY:abcdefghijk", "ApiKey: abcdefghijkl tail", "AKIAAKIA" + "B" * 13, "😀" + key[:16] + "\n" + key[:15], "SECRET\t= abcdefghijklm",
        "pa\u017fsword=abcdefghijklmnop to\u212aen=abcdefghijklmnop", f"token\"  :  \"{key[:12]}\"{key}",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for text, spans in spans_of(frame) + spans_of(odd):
        assert [s for s in spans if s[0] != "random"] == base_spans(text), text
    assert secret_scan.find_secrets(none).collect() == []
    assert set(secret_scan.find_secrets(odd).columns) == set(odd.columns)


def random_keys(n=60):
    draw = random.Random(7)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    keys = [base64.b64encode(draw.randbytes(30)).decode() for _ in range(n)]
    keys += ["".join(draw.choice(upper) for _ in range(40)) for _ in range(n)]
    return keys + [draw.randbytes(20).hex().upper() for _ in range(n)]


def words(n=300):
    draw = random.Random(8)
    return ["".join(draw.choice(["er", "ein", "heit", "ung", "tion", "keit", "and", "ver"]) for _ in range(9)) for _ in range(n)]


def test_battery_finds_keys_and_leaves_words(spark):
    keys, plain = random_keys(), words() + ["https://example.org/" + "/".join(w[:7] for w in words(8))]
    frame = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {text: [s for s in spans if s[0] == "random"] for text, spans in spans_of(frame)}
    hits = sum(found[f"see {k} here"] == [("random", 4, 4 + len(k))] for k in keys)
    assert hits >= 0.93 * len(keys)
    assert not any(found[f"see {w} here"] for w in plain)


def test_battery_finds_keys_alone_in_their_band_and_weighs_structure(spark):
    draw = random.Random(11)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = (base62, base62 + "+/", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    keys = ["".join(draw.choice(alphabet) for _ in range(n)) for alphabet in alphabets for n in (24, 40, 80, 160, 320)]
    plain = ["check_training_module", "NORMALIZE_WHITESPACE", "clear_binding_outputs", "src/main/java/org/quick/Fox/java"]
    frame = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {text: [s for s in spans if s[0] == "random"] for text, spans in spans_of(frame)}
    assert sum(found[f"see {k} here"] == [("random", 4, 4 + len(k))] for k in keys) >= len(keys) - 1
    assert not any(found[f"see {w} here"] for w in plain)


def test_battery_finds_keys_of_one_case_and_digits(spark):
    draw = random.Random(12)
    alphabets = ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    kinds = [["".join(draw.choice(alphabet) for _ in range(n)) for _ in range(40)] for alphabet in alphabets for n in (32, 40, 64)]
    keys, plain = sum(kinds, []), words() + [w.upper() for w in words()]
    frame = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {text: [s for s in spans if s[0] == "random"] for text, spans in spans_of(frame)}
    for kind in kinds:
        assert sum(found[f"see {k} here"] == [("random", 4, 4 + len(k))] for k in kind) >= 0.9 * len(kind)
    assert not any(found[f"see {w} here"] for w in plain)


def test_battery_p_values(spark):
    keys = random_keys()
    frame = spark.createDataFrame([(k,) for k in keys + ["a" * 40, "ab" * 20]], "text string")
    rows = secret_scan.candidates(frame, F.col("text")).select("text", F.explode("random").alias("x")).select("text", "x.*").collect()
    p = {r["text"]: r["p"] for r in rows}
    assert p["a" * 40] < 1e-9 and p["ab" * 20] < 1e-9
    values = np.array([p[k] for k in keys])
    assert abs(values.mean() - 0.5) < 0.1 and (values < 0.01).mean() < 0.06
    for text, encoding in ((keys[0], "base64"), (keys[60], "base32"), (keys[120], "hex")):
        row = next(r for r in rows if r["text"] == text)
        alphabet = dict((e[0], e[2]) for e in secret_scan.ENCODINGS)[encoding]
        body = text.rstrip("=").lower() if encoding == "hex" else text.rstrip("=")
        if row["encoding"] != encoding:
            continue
        n, k = len(body), len(alphabet)
        chi = k / n * sum(c * c for c in Counter(body).values()) - n
        assert 0 <= row["p"] <= 1 and chi > 0


def test_redaction(spark, odd):
    key = hashlib.sha256(b"y").hexdigest()
    rows = [(1, f"é token={key}, and {key} end"), (2, "nothing"), (3, None)]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "é <secret>, and <secret> end", 2: "nothing", 3: None}
    assert secret_scan.redact(odd).columns == odd.columns


def same_as_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = db.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(tuple, queries.queries()[name](spark, sf).select(columns).collect()), key=str) == sorted(result.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_queries_agree_with_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


def test_urls_of_every_form(spark, none):
    urls = [
        None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://a.org/x", "http://borg/", "https://m.Example.ORG/es/1?q",
        "http://example.org/en/19#x", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/?a=/fr/", "http://x.com?y://z/fr/",
        "http://İ.com/de/", "a\nhttp://x.org/\ny", "ftp://u:p@x.com:80/fr/",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}

    def judge(url):
        rest = (url or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, rule and rule.name, rule and rule.verdict

    for i, url in enumerate(urls):
        host, path, rule, verdict = judge(url)
        assert got[i][:3] == (host, path, rule) and (verdict is None or got[i][3] == verdict), url
    assert url_filter.judge_urls(pages.limit(0)).collect() == []
    clash = pages.withColumns({"host": F.lit(1), "mass": F.lit(2), "src": F.lit(3), "trust": F.lit("x")})
    assert url_filter.judge_urls(clash).count() == len(urls)


def test_trust_and_distrust_follow_links(spark):
    def page(i, host, path, *links):
        html = "".join(f'<a href="http://{x}/p">x</a><a HREF=/local>y</a>' for x in links)
        return i, f"http://{host}{path}", html

    rows = [
        page(1, "good.org", "/", "friend.net", "friend.net"), page(2, "friend.net", "/", "far.net"), page(3, "far.net", "/"),
        page(4, "bad.com", "/de/"), page(5, "shady.net", "/", "bad.com"), page(6, "worse.net", "/", "shady.net"), page(7, "lonely.net", "/"),
        page(8, "bad.com", "/xx/"),
    ]
    got = {r["host"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {h: r["verdict"] for h, r in got.items() if h.endswith(".net")} == {
        "friend.net": "allow", "far.net": "allow", "shady.net": "block", "worse.net": "block", "lonely.net": "allow"
    }
    verdicts = [r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(verdicts) == 8
    trust, units = {"good.org": 1.0}, float(url_filter.UNITS)
    for _ in range(url_filter.ROUNDS):
        trust = {"good.org": 0.15, "friend.net": 0.85 * trust.get("good.org", 0), "far.net": 0.85 * trust.get("friend.net", 0)}
    for host, mass in trust.items():
        assert abs(got[host]["trust"] / units - mass) < 1e-9


def counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    repeated = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(repeated),
    )


def test_rule_counts(spark, sf, texts, odd, none):
    got = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, sf).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        want, row = counts(text), got[doc_id]
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["kept"] and row["base_failed"])
    model = quality_rules.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality_rules.quality_rules(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        q = r["quality"]
        assert tuple(q)[:5] == counts(r["text"])
    assert quality_rules.quality_rules(none, model).collect() == []


def learnt(spark, name):
    """Rows of a query over the 0.01 tables with their labels."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return queries.queries()[name](spark, sf).join(labels, "doc_id").collect()


def area(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_line_field_on_held_out_rows(spark):
    rows = [r for r in learnt(spark, "op8_quality_crf") if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert area([r["score"] for r in rows], [r["label"] for r in rows]) > 0.9
    right = [r["predicted"] == r["label"] for r in rows]
    assert sum(right) / len(right) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_rules_keep_good_rows(spark):
    rows = [r for r in learnt(spark, "op10_quality_rules") if not r["base_failed"]]
    assert sum(r["kept"] for r in rows if r["label"]) / sum(r["label"] for r in rows) > 0.98
    assert area([r["score"] for r in rows], [r["label"] for r in rows]) > 0.9


def test_marginals_by_brute_force():
    draw = np.random.default_rng(1)
    turns, ends = draw.normal(size=(2, 2)), np.array([0, 1, 6, 10])
    unary = draw.normal(size=10) * 2
    got, pairs = quality_crf.marginals(unary, ends, turns)
    want, want_pairs = np.zeros(10), np.zeros((2, 2))
    for low, high in zip(ends[:-1], ends[1:]):
        total, sums, both = 0.0, np.zeros(high - low), np.zeros((2, 2))
        for state in range(2 ** (high - low)):
            bits = [state >> i & 1 for i in range(high - low)]
            p = np.exp(sum(u for u, b in zip(unary[low:high], bits) if b) + sum(turns[a, b] for a, b in zip(bits, bits[1:])))
            total += p
            sums += p * np.array(bits)
            for a, b in zip(bits, bits[1:]):
                both[a, b] += p
        want[low:high] = sums / total
        want_pairs += both / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_line_field_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, marks in ((odd, labels), (none, labels), (odd, labels.limit(0))):
        field = quality_crf.train(docs, marks)
        rows = quality_crf.score_quality(odd, field).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_crf.score_quality(none, field).collect() == []


def test_line_field_learns_from_whole_texts(spark):
    draw = random.Random(13)
    clean = lambda n: [" ".join(draw.choice(["tree", "river", "house", "stone", "cloud"]) for _ in range(9)) + "." for _ in range(n)]
    junk = lambda n: ["$$$ | FREE!!! | 77%%% | " * draw.randrange(1, 4) for _ in range(n)]
    texts = [clean(600) if i % 2 else junk(180) + clean(240) + junk(180) for i in range(60)]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for lines in (quality_crf.TRAINING_LINES, 12_000):
        rows = quality_crf.score_quality(docs, quality_crf.train(docs, labels, lines=lines)).collect()
        assert area([r["score"] for r in rows], [r["doc_id"] % 2 for r in rows]) > 0.95
    assert quality_crf.fitting([(1, 5), (2, 99), (3, 5), (4, 1)], 10) == [1, 3]
    assert quality_crf.fitting([], 10) == []


def test_models_do_not_depend_on_the_order_of_rows(spark):
    """Labels and texts that repeat a doc_id."""
    words = ["tidy", "prose", "about", "rivers", "zzz", "$$", "win", "now"]
    texts = [(i % 40, "\n".join(" ".join(words[(i * k + j) % 8] for j in range(5)) for k in range(1, 4))) for i in range(60)]
    marks = [(i % 40, i // 3 % 2) for i in range(70)]
    found, learnt = [], []
    for parts, turn in ((1, 1), (3, -1), (7, 1)):
        docs = spark.createDataFrame(texts[::turn], "doc_id long, text string").repartition(parts)
        labels = spark.createDataFrame(marks[::turn], "doc_id long, quality int").repartition(parts)
        rules, field = quality_rules.train(docs, labels), quality_crf.train(docs, labels)
        found.append((rules.weights.tolist(), rules.intercept, rules.slope, rules.shift))
        learnt.append([field.weights.tolist(), field.intercept, field.turns.tolist(), field.slope, field.shift])
    assert any(found[0][0]) and found[0] == found[1] == found[2]
    assert learnt[0] == learnt[1] == learnt[2]


def test_logistic_and_calibration():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 5))
    true = np.array([2.0, -1.0, 0.0, 0.5, 0.0])
    y = (draw.random(400) < sigmoid(x @ true)).astype(float)
    w, b = fit(x, y, rounds=500)
    assert np.corrcoef(w, true)[0, 1] > 0.95
    slope, shift = calibrate(x @ w + b, y)
    assert abs(sigmoid(slope * (x @ w + b) + shift).mean() - y.mean()) < 0.01
    assert fit(x, np.ones(400))[1] == 0.0 and calibrate(np.zeros(0), np.zeros(0)) == (1.0, 0.0)
    assert len(WordHasher().of(b"a b\x0bc")) == 3
