"""Hard negatives, URL filters and phrase collocations by brute force, with odd rows."""

import random
import re
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweft.llm import collocations, negatives, urls

VECTORS = "vec_id long, label int, embedding array<float>, size int"


def vectors(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dim))
    rows = [(k, int(rng.integers(5)), None) for k in range(n)]
    rows = [(k, y, (centres[rng.integers(5)] * rng.uniform(0.2, 3) + rng.normal(0, 0.4, dim)).astype(np.float32).tolist()) for k, y, _ in rows]
    rows += [(n + k, 1, rows[4][2]) for k in range(12)]  # ties
    rows += [(n + 20, 1, [0.0] * dim), (n + 21, 2, [1.0] * 3), (n + 22, 2, [2.0] * 3), (n + 23, 3, []), (n + 24, None, rows[0][2])]
    rows += [(n + 30, 1, None), (n + 31, 1, [None] * dim), (n + 32, 1, [float("nan")] * dim), (n + 33, 1, [float("inf")] * dim), (None, 1, rows[0][2]), rows[7], rows[20]]
    return [(*r, 9) for r in rows]


def negatives_by_force(rows, chosen, positives=5, many=10, least=30, most=90):
    good = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v, _ in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({r[0] for r in good if chosen(r[0])}):
        label, q = min((y, v) for i, y, v in good if i == a)
        scored = sorted((-sum(x * z for x, z in zip(q, v)), i, y) for i, y, v in good if i != a and len(v) == len(q))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            hard = [(n, t) for t, n, y in scored if y != label and least * -s <= 100 * -t <= most * -s][:many]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "worth"), [(8192, 0.25), (9, 2.0)])
def test_hard_negatives_by_force(spark, monkeypatch, shard, worth):
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    monkeypatch.setattr(negatives, "BUCKETS", 4)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "WORTH", worth)
    rows = vectors(3, 160)
    held = negatives.whole_numbers(spark.createDataFrame(rows, VECTORS))
    got = negatives.hard_negatives(held, held.where("vec_id % 10 = 0 or vec_id > 160")).collect()
    want = negatives_by_force(rows, lambda i: i % 10 == 0 or i > 160)
    assert sorted(map(tuple, got)) == want and len(want) > 300
    none = held.where("false")
    assert negatives.hard_negatives(none, none).count() == negatives.hard_negatives(held, none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_feasible_rows_hold_all_in_range(seed, monkeypatch):
    """The intervals lose no row whose score is in range, and rule out rows of a narrow one."""
    monkeypatch.setattr(negatives, "WORTH", 2.0)
    rng = np.random.default_rng(seed)
    dim = [2, 3, 8, 20, 64, 5][seed]
    points = np.floor(rng.normal(0, 40, (400, dim)) * rng.uniform(0.8, 1.2, (400, 1)) + (30 if seed % 2 else 0))
    shard = negatives.Shard(np.arange(400), np.zeros(400, np.int64), points)
    least = 400
    for _ in range(30):
        q = np.floor(rng.normal(0, 30, dim) + (20 if seed % 2 else 0))
        score = shard.points @ q
        low, high = np.sort(rng.choice(score, 2)) if rng.random() < 0.7 else (np.sort(score)[-3], np.inf)
        left = shard.feasible(q, float(low), float(high))
        assert set(np.flatnonzero((score >= low) & (score <= high))) <= set(left.tolist())
        least = min(least, len(left))
    assert least < 200 or dim > 8  # coordinates of directions in many dimensions rule out little


def test_products_beyond_doubles():
    q, p = np.array([[2.0**30 + 1, 2.0**30, 1.0]]), np.array([[2.0**29 + 3, -(2.0**28), 5.0], [1.0, 0.0, 2.0**30]])
    assert negatives.exact(q, p).tolist() == [[(2**30 + 1) * (2**29 + 3) - 2**58 + 5, 2**30 + 1 + 2**30]]
    assert negatives.exact(q * 2.0**20, p * 2.0**20).tolist() == [[((2**30 + 1) * (2**29 + 3) - 2**58 + 5) << 40, (2**31 + 1) << 40]]


def judged_by_force(rows, rules, default="allow"):
    out = []
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = lower(host)
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in ((lower(h or ""), p or "", v) for h, p, v in rules) if (p == "" or p[0] == "/") and (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((i, host, path, best[3] if best else None, best[4] if best else default))
    return sorted(out, key=repr)


ODD_URLS = [None, "", "no scheme", "http://", "http:///path", "HTTP://A.Example.NET/EN/x", "http://net", "http://net/", "http://x.net?q=/en/", "http://net.example.com/de", "http://x.net:80/", "http://u@b.example.net/en/", "ftp://.example.net/en/", "http://example.net./en/", "http://a..net/", "x://exämple.net/en/ß", "http://example.com/de/a/b/c#f", "a://b://c.net/d", "http://notexample.net/en/", "http://x.example.net/e\nn/"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("example.com", "/de/a", "allow"), ("EXAMPLE.com", "/de/a/b", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("org", "/fr/", "block"), ("b.a.org", None, "allow"), ("w3.org", "x", "block"), ("c", "/d", "allow")]


@pytest.mark.parametrize(("sample", "parts"), [(32, 2), (1, 9)])
def test_urls_by_force(spark, monkeypatch, sample, parts):
    monkeypatch.setattr(urls, "SAMPLE", sample)
    monkeypatch.setattr(urls, "PARTS", parts)
    rng = random.Random(sample)
    hosts = ["example.net", "m.example.net", "a.b.example.net", "example.com", "z.example.com", "org", "a.org", "b.a.org", "q.b.a.org", "z", "c"]
    rows = [(k % 150, f"{rng.choice(('http', 'https'))}://{rng.choice(hosts)}{rng.choice(('', '/', '/en/', '/en', '/de/', '/de/a/b', '/fr/1', '/d'))}{rng.choice(('', quote(str(k)), '?x=/de/'))}") for k in range(200)]
    rows += [(1000 + k, x) for k, x in enumerate(ODD_URLS)] + [(7, "http://a.example.net/en/1")] * 90 + [(None, "http://a.example.net/en/1")] * 3
    frame = spark.createDataFrame([(*r, 1, "r") for r in rows], "page_id long, url string, keys int, rule string")
    for rules in (RULES, RULES + [(None, None, "block"), ("", "/en", "allow")]):
        got = urls.judged(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        assert sorted(map(tuple, got), key=repr) == judged_by_force(rows, rules)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judged(frame, none, default="block").collect()} == {"block"}
    assert urls.judged(frame.where("false"), spark.createDataFrame(RULES, none.schema)).count() == 0


def collocations_by_force(rows, size, least, share, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, size + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in found.items():
        inside = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in inside):
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), k))
    return sorted((lang, n + 1, p.decode(), -a, f[lang, tuple(p.decode().split(" ")[:k])], f[lang, tuple(p.decode().split(" ")[k:])], total[lang], -s, k) for lang, rs in out.items() for n, (s, a, p, k) in enumerate(sorted(rs)[:top]))


@pytest.mark.parametrize(("size", "trigger", "gather", "top"), [(5, 16, 10**6, 2000), (5, 2, 500, 7), (3, 1, 10**6, 2000), (7, 4, 3000, 40)])
def test_collocations_by_force(spark, monkeypatch, size, trigger, gather, top):
    monkeypatch.setattr(collocations, "GATHER", gather)
    rng = random.Random(size * 31 + trigger)
    fixed = [" ".join(f"p{rng.randrange(40)}" for _ in range(n)) for n in (2, 3, 4, 5, 6, 9, 30)]
    def text():
        return "".join(rng.choice(fixed) if rng.random() < 0.4 else f"W{int(rng.paretovariate(0.8)) % 60}" for _ in range(1)) + rng.choice((" ", " ", "  ", "\t", ", ", ". ", "\n", " \x85", "\u00a0", "; "))
    rows = [(rng.choice(("en", "en", "de", None, "")), "".join(text() for _ in range(rng.randrange(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("de", ""), (None, " ., "), ("en", "a " * 3000), ("und", "Ä ß ä " * 50), rows[3], rows[3], rows[9]]
    frame = spark.createDataFrame([(k, lang, t, 5) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, f int")
    got = collocations.collocations(frame, size=size, least=12, share=100, top=top, trigger=trigger).collect()
    want = collocations_by_force(rows, size, 12, 100, top)
    assert sorted(map(tuple, got)) == want and len(want) > 20
    assert collocations.collocations(frame.where("false"), size=size).count() == 0


def test_chunks_overlap_by_a_window():
    """Chunks of a text, less the window each but the last shares with the next, are the text; equal passages are cut alike."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(50)}" for _ in range(500)]
    passage = [f"x{k}" for k in range(120)]
    text = " ".join(words[:250] + passage + words[250:] + passage)
    found = collocations.parse(Counter({text: 3}), 4, 8)
    assert set(found.values()) == {3, 6} and sum(k[1] * v for k, v in found.items()) == 3 * 740
    repeated = [k[0] for k, v in found.items() if v == 6]
    assert all(x.startswith("x") for c in repeated for x in c.split()) and len(repeated) > 5


def test_huge_counts_are_exact(spark):
    """a * n passes 64 bits."""
    up = spark.createDataFrame([(4_000_000_000_000, 9_000_000_000_000_000, 5_000_000_000_000, 6_000_000_000_003)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = up.withColumn("_up", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("_down", wide("l") * wide("r")).select(F.expr("_up div _down").alias("s")).first().s
    assert got == 1000 * 4_000_000_000_000 * 9_000_000_000_000_000 // (5_000_000_000_000 * 6_000_000_000_003)
