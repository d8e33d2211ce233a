"""Phrases, near vectors and the manifest against plain versions and on edges; scratches; numbers that are nobody's."""

import hashlib
import random
import re
import threading
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratiform.llm import html_extract, manifest, phrases, pii, vectors
from stratiform.llm.common import Scratch, own_scratch, scratch_of

# ---- phrases ---------------------------------------------------------------------------------------------------------

TEXTS = [("en", "New York, new york! New\tYork city. In new york city; new york city"), ("en", None), (None, "a b a b a b\na b"), ("und", "A B; ü ü ü"), ("fr", ""), ("fr", " \t \n,."), ("en", "x\x0by\x0cz\rNew  York"), ("en", "new york city " * 20), ("de", "ÄÖ äö ÄÖ äö"), ("en", "one word two lines")]


def plain_phrases(rows, least, share, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    key = lang, tuple(ws[i : i + k])
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if len(p) == 2 and any(g == lang and len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= share * a for (g, q), b in cand.items()):
            continue
        s, i = min((10**6 * a * a // (f[lang, p[:i]] * f[lang, p[i:]]), i) for i in range(1, len(p)))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:i]], f[lang, p[i:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, got in out.items() for r, (s, a, p, x, y) in enumerate(sorted(got)[:top], 1))


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, lang, t, 1, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase int, _text int")


def test_phrases_equal_plain_version(spark, monkeypatch):
    r = random.Random(2)
    rows = TEXTS + [(r.choice(["en", "de", None]), "".join(r.choice(["aa", "bb", "cc", "Dd", "é", "b"]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ""]) for _ in range(r.randint(0, 80)))) for _ in range(80)]
    df = doc_frame(spark, rows)
    for least, top in ((2, 2000), (3, 5)):
        got = sorted(tuple(x) for x in phrases.mine(df.repartition(5), least=least, top=top).collect())
        assert got == plain_phrases(rows, least, 50, top)
    want = plain_phrases(rows, 2, 50, 2000)
    for name in ("MAX_WORDS", "MAX_WORD_BYTES", "MAX_PAIRS"):
        monkeypatch.setattr(phrases, name, 0)
        assert sorted(tuple(x) for x in phrases.mine(df, least=2).collect()) == want, name
    assert phrases.mine(df.where("false")).count() == 0 and phrases.mine(df.where("text is null")).count() == 0


def test_windows_end_where_pieces_end():
    r = random.Random(3)
    texts = ["".join(r.choice("ab .,\n") for _ in range(r.randint(0, 60))) for _ in range(60)] + ["x" * 500 + " y" * 300]
    raw, at = phrases.raw_texts(pa.array([*texts, None]))
    count = lambda most: Counter((bytes(w), int(t), int(p)) for lo, hi in phrases.windows(raw, at, most) if (got := phrases.words(raw, at, lo, hi)) for w, t, p in zip(got[0].to_pylist(), got[1], np.unique(got[2], return_inverse=True)[1] * 0, strict=True))
    cuts = list(phrases.windows(raw, at, 20))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert all(hi in at or chr(raw[hi - 1]) in ".,\n" for _, hi in cuts)
    assert count(7) == count(20) == count(1 << 20)


def test_scores_are_exact(spark):
    rows = [(99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (12_345_678_901, 98_765_432_109, 12_345_678_907), (10, 10, 11), (7, 9, 11)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(int(x.s) == 10**6 * x.a * x.a // (x.l * x.r) for x in got)


# ---- vectors ---------------------------------------------------------------------------------------------------------

def plain_links(rows):
    """rows of (key, list or None): links and the smallest key reachable, by position."""
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    near = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9] for i, a in enumerate(unit)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        name = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), name, rows[i][0] == name))
    return sorted(out, key=repr)


def planted(n, dim, seed):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, dim)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for c in range(6):  # groups of near copies, exact copies, scaled copies
        for spread in (0.02, 0.05, 0.06):
            rows += [(len(rows) + j, (x[c] + spread * np.linalg.norm(x[c]) * g.standard_normal(dim) / np.sqrt(dim) * 3).astype(np.float32).tolist()) for j in range(15)]
        rows += [(len(rows) + j, x[c].tolist()) for j in range(5)] + [(len(rows) + 9, (2 * x[c]).tolist())]
    return rows


ODD = [(900_001, None), (900_002, []), (900_003, [0.0] * 16), (900_004, [1.0] * 15 + [None]), (900_005, [1.0] * 15 + [float("nan")]), (900_006, [float("inf")] + [1.0] * 15), (None, [1.0] + [0.0] * 15), (None, [1.0] + [0.001] * 15), (900_007, [1.0, 2.0]), (900_008, [2.0, 4.1]), (900_008, [2.0, 4.1]), (900_009, [-0.0, 1.0]), (900_010, [0.0, 1.0]), (900_011, [3.0]), (900_012, [5.0]), (900_013, [-5.0])]


def test_vectors_equal_brute_force(spark):
    rows = planted(150, 16, 1) + ODD
    df = spark.createDataFrame([(k, v, 1, 1) for k, v in rows], "vec_id long, embedding array<float>, node int, bucket int").repartition(4)
    want = plain_links(rows)
    assert max(n for _, n, _, _ in want) > 20
    for kw in ({}, {"cell": 16, "ball_least": 8}, {"cell": 8, "ball_least": 10**9}):
        assert sorted((tuple(r) for r in vectors.near_copies(df, **kw).collect()), key=repr) == want, kw
    assert vectors.near_copies(df.where("false")).count() == 0
    assert sorted((tuple(r) for r in vectors.near_copies(df.where("vec_id > 900000 and vec_id < 900007")).collect())) == [(k, 0, k, True) for k in range(900_001, 900_007)]


def test_cosine_just_over_the_limit_is_found():
    for dim, nodes in ((16, 1000), (64, 1000), (64, 10**7), (100, 10**5)):
        g = np.random.default_rng(dim)
        a = g.standard_normal((1500, dim))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = g.standard_normal((1500, dim))
        b -= (a * b).sum(1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        k = vectors.functions_for(dim, nodes)
        tables = vectors.tables_for(dim, k, 0.9)
        x, y = (vectors.buckets_of(v, dim, k, tables) for v in (a, 0.9 * a + np.sqrt(1 - 0.81) * b))
        met = np.mean([not set(p).isdisjoint(q) for p, q in zip(x.tolist(), y.tolist(), strict=True)])
        assert met > 0.99, (dim, nodes, met)
        far = np.mean([not set(p).isdisjoint(q) for p, q in zip(x.tolist(), np.roll(y, 1, 0).tolist(), strict=True)])
        assert far < 0.9 and (nodes < 10**7 or far < 0.05)


# ---- manifest --------------------------------------------------------------------------------------------------------

def plain_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(field(v) for v in r))

    def tree(hs):
        """Root and each one's siblings as (digest, first)."""
        level, of, ways = list(hs), list(range(len(hs))), [[] for _ in hs]
        while len(level) > 1:
            for i, p in enumerate(of):
                ways[i].append((level[p ^ 1] if p ^ 1 < len(level) else "", p & 1))
            level = [H(level[i] + (level[i + 1] if i + 1 < len(level) else "")) for i in range(0, len(level), 2)]
            of = [p // 2 for p in of]
        return level[0], ways

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        got = sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = got, *tree([leaf(r) for r in got])
    root, over = tree([trees[g][1] for g in langs]) if langs else (None, [])
    out = []
    for g, top in zip(langs, over, strict=True):
        got, sub, ways = trees[g]
        for r, way in zip(got, ways, strict=True):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for s, first in way + top:
                h = H(s + h if first else h + s)
            out.append((r[0], leaf(r), sub, root, H("".join(s for s, _ in way + top)), h, h == root))
    return sorted(out, key=repr)


def test_manifest_equals_plain_version(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", None]), r.choice(["en", "en", "en", "de", None]), r.choice([1, 20, None]), r.choice(["x", "", None, "ü" * 5])) for i in range(90)]
    rows += [(5, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (5, "b", "en", 1, "x"), (None, None, None, None, None), (None, None, None, None, None), (None, None, "en", 3, "y"), (1000, "s", "zz", 2, "alone"), (-7, "s", "é", 2, "w" * 70_000)]
    df = spark.createDataFrame([(*x, 1, 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf int, bucket int").repartition(6)
    want = plain_manifest(rows)
    for kw in ({}, {"levels": 2, "fan": 1}, {"levels": 1, "fan": 3}):
        assert sorted((tuple(x) for x in manifest.build(df, **kw).collect()), key=repr) == want, kw
    one = df.where("doc_id = 1000")
    assert sorted((tuple(x) for x in manifest.build(one).collect()), key=repr) == plain_manifest([x for x in rows if x[0] == 1000])
    assert manifest.build(df.where("false")).count() == 0


# ---- scratches -------------------------------------------------------------------------------------------------------

def test_a_step_ends_its_own_scratch_alone(spark):
    seen = {}
    ready, done = threading.Event(), threading.Event()

    def other():
        seen["frame"] = scratch_of(spark).put(spark.range(5), "other")
        ready.set()
        done.wait(60)

    with own_scratch(spark) as mine:
        assert scratch_of(spark) is mine
        t = threading.Thread(target=other)
        t.start()
        ready.wait(60)
        inner = scratch_of(spark).put(spark.range(3), "inner")
        kept = Scratch(spark).put(spark.range(4), "kept")
    done.set()
    t.join()
    assert seen["frame"].count() == 5 and kept.count() == 4 and scratch_of(spark) is not mine
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner._scratch_path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---- personal data and pages -----------------------------------------------------------------------------------------

PLACES = ["In the ledger of", "Rainfall by month:", "The sequence is", "Seats per row:", "Lottery draws:", "Pages", "Budget for the years", "Scores were", "Population (thousands):", "Prime numbers:"]


def number_sentences(n, seed):
    """Sentences full of numbers that are nobody's, by other rules than those of the labelled table."""
    r = random.Random(seed)
    row = lambda make, sep: sep.join(make() for _ in range(r.randint(2, 40)))
    makers = [lambda: str(r.randint(1000, 2030)), lambda: str(r.randint(1, 9)), lambda: str(r.randint(10, 99)), lambda: str(r.randint(100, 9999)), lambda: str(r.randint(10**5, 10**9)), lambda: f"{r.uniform(0, 99):.2f}", lambda: f"{r.randint(1, 99)},{r.randint(0, 9)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1950, 2030)}", lambda: f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 999)} {r.randint(100, 999)}", lambda: f"€{r.randint(1, 5000)}", lambda: f"{r.randint(1, 99)} %", lambda: f"{r.randint(1, 20)}:{r.randint(10, 59)}"]
    return [f"{r.choice(PLACES)} {row(r.choice(makers), r.choice([' ', ' ', ', ', '; ', ' | ', ' and ']))}{r.choice(['.', '', ' in total.'])}" for _ in range(n)]


def test_numbers_that_are_nobodys_stay():
    field = pii.train()
    texts = number_sentences(500, 9) + ["years 1914 1918 1939 1945", "Table: 1200 1350 1410 1502 1600 1733", "3 5 8 13 21 34 55 89 144 233", " ".join(str(i * 7 + 100) for i in range(200)), "12,5 13,5 14,5 15,5", "Meet me at Central dot com boom crash", "+1 " * 1000]
    for t, added in zip(texts, field.spans(texts), strict=True):
        assert added == [], t


def test_announced_and_written_numbers_are_found():
    r = random.Random(4)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    forms = [lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(2)} {d(3)} {d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(10)}", lambda: f"0{d(3)}/{d(6)}"]
    leads = ["please call {} before noon", "Our office, tel. {}, is closed", "phone: {}", "You can phone {} any time.", "call {} now", "Fax: {} (day)"]
    found = 0
    for i in range(200):
        number = forms[i % len(forms)]()
        t = r.choice(leads).format(number)
        got = pii.merged(pii.base_spans(t), field_spans(t))
        found += any(k == "phone" and number in t[a:b] for k, a, b in got)
        assert all(b - a < 40 for _, a, b in got)
    assert found >= 190, found


def field_spans(t):
    return pii.train().spans([t])[0]


def test_masking_takes_any_column_name(spark):
    df = spark.createDataFrame([(1, "call 0171 5551234 now", 2)], ["doc.id", "text", "a.b`c"])
    out = pii.mask_documents(df, pii.train())
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "call <PHONE> now", 2)]


def test_pages_with_sections_of_data_and_deep_ones():
    m = html_extract.train()
    p = "the words of a long paragraph in the article that goes on for a while."
    assert m.extract([f"<body><article><h1>Title here</h1><p>First {p}</p><![CDATA[ x ><p>Last {p}</p></article></body>"])[0] == f"Title here\nFirst {p}\nLast {p}"
    assert html_extract.Page("<div data-class='nav' class=content data-id=ad>x").words[1] == ("content",)
    n = 100_000
    for page in ("<div>" * n, "<div>" * n + "</p>" * n, "<i>" * n + "</b>" * n, "</p>" * n, "<li>x" * n, "<td>" * n + "</tr>" * n):
        begin = time.process_time()
        html_extract.Page(page)
        assert time.process_time() - begin < 4, page[:9]
