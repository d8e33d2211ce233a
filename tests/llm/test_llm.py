"""Operators against brute force, on edge cases, and on held-out labels."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.llm import decontam, html_extract, langid, linefreq, ngram_join, packing, pii, quality, queries, sharding, toxicity

D = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls, empty and blank texts, repeated rows and a long text; columns whose names operators use inside.
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "a b", "en", None), (4, "a b", "en", None), (5, "The same words again and again. " * 4, "en", "a"), (6, "the SAME words again and again. " * 4, "fr", "b"), (None, "no key here at all, friend", "en", "b"), (7, "word " * 50_000, "en", "b"), (8, "été ñandú größe x1 y2 z3 q4", "fr", "b")]


def edge(spark):
    rows = [(i, t, lang, s, None, 1, 2, 3) for i, t, lang, s in EDGE]
    return spark.createDataFrame(rows, DOC + ", row int, node int, score int")


def random_docs(n=120, seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 90))] for _ in range(n // 3)]
    shared = [r.choice(vocab) for _ in range(30)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocab)
        if r.random() < 0.3:
            words += shared
        out.append((i, " ".join(w.upper() if r.random() < 0.2 else w for w in words)))
    return out


def plain_components(docs):
    def shingles(t):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = {i: shingles(t) for i, t in docs}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join_equals_brute_force(spark):
    docs = random_docs()
    out = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain_components(docs)


def test_ngram_join_edges(spark):
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(edge(spark)).collect()]
    got = {(i, n, c) for i, n, c in out}
    assert len(out) == len(EDGE)
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (6, 6, 5), (7, 1, 7)} <= got
    assert ngram_join.join(edge(spark).where("false")).count() == 0
    one = ngram_join.one_of_each(edge(spark))
    assert one.columns == edge(spark).columns
    kept = [r.doc_id for r in one.collect()]
    assert kept.count(4) == 1 and 6 not in kept and {1, 2, 3, 5, 7, 8} <= set(kept)


def test_one_of_each_judges_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    near = a.replace("a29", "zz")
    rows = [(3, b), (5, a), (5, b), (7, a), (9, c), (9, near), (None, c), (None, "unlike any other text of them all"), (4, None), (4, None), (4, "")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _h int, _stays int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect()), key=str)
    assert got == sorted([(3, b), (5, a), (9, c), (None, "unlike any other text of them all"), (4, None), (4, None), (4, "")], key=str)
    out = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join(df).collect()}
    assert out[None, 26] == 9 and out[None, 3] is None and out[4, 0] == 4
    text_keys = df.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    assert {r.component_id for r in ngram_join.join(text_keys).where("doc_id = 'k7'").collect()} == {"k5"}
    assert packing.pack(text_keys).where("doc_id = 'k7'").count() > 0


def check_packing(rows, docs, encode):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    ids = {i: np.append(encode(t), np.uint32(1)).astype("<u4") for i, t in docs}
    for i, full in ids.items():
        at = 0
        for p in sorted((r for r in rows if r.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(full) and p.ids_crc32 == zlib.crc32(full[at : at + p.length].tobytes())
            at += p.length
        assert at == len(full)
    return by


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder()
    docs = [*random_docs(60), (900, None), (901, ""), (902, "x <|endoftext|> y"), (903, "Ünïcode  \n\n tabs\t\t 123 don't"), (904, "long " * 9000)]
    r = random.Random(8)
    odd = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(1, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t in [t for _, t in docs] + odd:
        assert encode(t).tolist() == plain.encode(t or "", add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    check_packing(rows, docs, encode)
    assert packing.pack(edge(spark).where("false")).count() == 0
    same = spark.createDataFrame([(i % 3, "the same words") for i in range(400)], "doc_id long, text string").repartition(4)  # ties and repeated rows
    rows = packing.pack(same).collect()
    n = len(encode("the same words")) + 1
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == sorted((i % 3, 0, n) for i in range(400))
    for n in range(1, 5000, 7):
        assert sum(packing.cut(n)) == n and max(packing.cut(n)) <= 2048 and min(packing.cut(n)) >= 1


def plain_decontamination(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = [(i, tuple(ws[k : k + 13])) for i, t in items if (ws := low(t)) for k in range(max(1, len(ws) - 12))]
    out = []
    for d, t in docs:
        ws, hit, found = low(t), set(), set()
        for i, w in wins:
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(str(i))
        out.append((d, len(ws), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    docs = [*random_docs(60), (300, None), (301, ""), (302, "w1"), (302, "w1")]
    items = [(0, docs[1][1]), (1, docs[7][1] + " w1 w2"), (2, "w1"), (3, "w3 w4"), (4, None), (5, "!!"), (6, "never-there zzz w5"), (7, docs[1][1])]
    out = decontam.assess(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out), key=str) == plain_decontamination(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.assess(edge(spark), none).where("contaminated or n_hit > 0").count() == 0
    assert decontam.assess(edge(spark).where("false"), none).count() == 0


def test_proximity_equals_brute_force(spark):
    from stratiform.llm.common import Scratch

    docs = [*random_docs(50), (300, "w1 x w3 y w2"), (301, "w1 " + "x " * 30 + "w3 w2"), (302, None)]
    items = [(0, docs[1][1]), (1, "w3 w1 w2"), (2, "w5"), (3, "w7 w8"), (4, "w9 never-there"), (5, None)]
    low = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    words = {i: low(t) for i, t in docs}
    df = Counter(w for ws in words.values() for w in ws)
    scratch = Scratch(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = decontam.windows(bench, item="item_id", text="text")
    vocab = wins.select(F.explode("terms").alias("word")).distinct()
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), vocab, scratch, key="doc_id", text="text")
    found = decontam.proximity_matches(index, wins.groupBy("w", "size").agg(F.first("terms").alias("terms")), scratch, slop=6)
    got = {(r.doc_id, r.w, r.pos) for r in found.join(index.docs, "row").collect()}
    want = set()
    for r in wins.collect():
        terms = sorted(set(r.terms), key=lambda w: (df[w], w))
        for i, ws in words.items():
            for p, w in enumerate(ws):
                if w == terms[0] and set(terms) <= set(ws[max(0, p - 6) : p + 7]):
                    want.add((i, r.w, p))
    assert got == want and any(i == 300 for i, _, _ in got) and not any(i == 301 for i, _, _ in got)


def test_keep_clean_judges_rows(spark):
    hit = " ".join(f"b{i}" for i in range(20))
    rows = [(None, hit), (2, hit), (2, "clean words here"), (3, "other"), (None, None), (5, ""), (3, "other")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _h int")
    bench = spark.createDataFrame([(1, hit)], "item_id long, text string")
    left = decontam.keep_clean(df, bench)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([r for r in rows if r[1] != hit], key=str)


def test_sharding(spark):
    docs = spark.createDataFrame([(i, f"t{i % 9}") for i in range(3000)] + [(None, None), (5, "t5")], "doc_id long, text string")
    rows = sharding.assign(docs).collect()
    assert {r.shard for r in rows} == set(range(40))
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and any(r.grown_shard == 40 for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert next(r.size for r in rows if r.doc_id is None) == 16
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert sharding.assign(docs.where("false")).count() == 0
    heavy = sharding.descend(spark.range(8000).withColumnRenamed("id", "doc_id"), "doc_id", sharding.layout(40, weights={0: 5.0}), "shard")
    light = sharding.descend(spark.range(8000).withColumnRenamed("id", "doc_id"), "doc_id", sharding.layout(40), "shard").withColumnRenamed("shard", "before")
    moved = heavy.join(light, "doc_id").where("shard <> before")
    assert moved.where("shard >= 20").count() == 0  # only into the region whose weight grew
    assert heavy.where("shard = 0").count() > 3 * light.where("before = 0").count()


def test_sharding_equals_plain_descent(spark):
    import math

    import xxhash

    def draw(key, node):
        h = xxhash.xxh64_intdigest(node.name.encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / node.total

    def plain(key, shards):
        node = sharding.layout(shards)
        while node.shard is None:
            node = min(node.children, key=lambda c: draw(key, c))  # of ties the first
        return node.shard

    rows = sharding.assign(spark.createDataFrame([(i,) for i in range(400)], "doc_id long").withColumn("text", F.lit("é"))).collect()
    assert [(r.shard, r.grown_shard, r.size) for r in rows] == [(plain(str(r.doc_id), 40), plain(str(r.doc_id), 41), 18) for r in rows]


def test_automaton_and_cross_parsing(spark):
    m = langid.CrossParser().fit([("a", "abcabcabd"), ("b", "xyzzyxxyz")])
    assert m.predict(["abcab", "xyz", "", None, "123 !"])[0] == ["a", "b", "und", "und", "und"]

    def plain(text, train):  # greedy longest matches; a letter that never occurs is its own phrase
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in train:
                k += 1
            n, i = n + 1, i + k
        return n

    r = random.Random(2)
    for _ in range(20):
        t = "".join(r.choice("abcdxy") for _ in range(r.randint(1, 60)))
        assert m.phrases([m.symbols(t)[0]])[0].tolist() == [plain(t, "abcabcabd"), plain(t, "xyzzyxxyz")]
    long_train = "".join(r.choice("abcd é𐐨") for _ in range(4000))
    m = langid.CrossParser().fit([("a", long_train)])
    squeeze = lambda t: re.sub(" +", " ", t)
    for t in ("".join(r.choice("abcd é𐐨q") for _ in range(5000)), "abc" * 1500, long_train[:3000] + long_train[100:2500], "q" * 2500):
        assert m.phrases([m.symbols(t)[0]])[0].tolist() == [plain(squeeze(t), squeeze(long_train))]
    texts = ["".join(r.choice("abcd q") for _ in range(r.choice([3, 900, 1024, 1025, 2100]))) for _ in range(30)]
    assert m.phrases([m.symbols(t)[0] for t in texts])[:, 0].tolist() == [plain(squeeze(t), squeeze(long_train)) for t in texts]
    out = langid.identify(edge(spark), langid.train(edge(spark)), keep=["doc_id"])
    assert out.count() == len(EDGE)
    assert {r.lang_pred for r in out.where("doc_id in (1, 2, 3)").collect()} == {"und"}
    empty = edge(spark).where("false")
    assert langid.identify(empty, langid.train(empty), keep=["doc_id"]).count() == 0


def test_language_with_more_letters_than_16_bits():
    letters = [chr(c) for c in range(0x3400, 0x2A6D0) if chr(c).isalpha()]
    assert len(letters) > 66_000
    last = "".join(letters[-2000:])
    parser = langid.CrossParser().fit([("han", " ".join("".join(letters[i : i + 2000]) for i in range(0, len(letters), 2000))), ("late", last), ("en", "plain words of a text in english " * 9)], train_symbols=80_000)
    assert parser.predict([last[700:1400], "plain words of a text"])[0] == ["late", "en"]


def test_language_of_long_texts_only(spark):
    docs = [(i, " ".join(f"the{j % 7} house{(i + j) % 11}" for j in range(60)).translate(str.maketrans("0123456789", "abcdefghij")), "en") for i in range(8)]
    docs += [(i, " ".join("el perro la casa niño mañana ciudad verde azul".split()[(i * j) % 9] for j in range(1200)), "es") for i in range(10, 18)]
    assert min(len(t) for i, t, _ in docs if i >= 10) > langid.MAX_CHARS
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    m = langid.train(df)
    assert m.languages == ["en", "es"]
    assert {r.lang_pred for r in langid.identify(df, m, keep=["doc_id"]).where("doc_id >= 10").collect()} == {"es"}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    right = lambda c: F.avg(c.cast("double"))
    assert queries.op5(spark, d).where("held_out").join(docs, "doc_id").agg(right(F.col("lang_pred") == F.col("lang"))).first()[0] > 0.97
    assert queries.op6(spark, d).where("held_out").join(labels, "doc_id").agg(right(F.col("predicted") == F.col("quality"))).first()[0] > 0.93
    assert queries.op9(spark, d).where("held_out").join(labels, "doc_id").agg(right(F.col("predicted") == F.col("toxic"))).first()[0] > 0.95


def test_classifiers_on_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for mod, train in ((quality, quality.train), (toxicity, toxicity.train)):
        model = train(edge(spark), none)
        rows = mod.score_documents(edge(spark), model, keep=["doc_id"]).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert mod.score_documents(edge(spark).where("false"), model, keep=["doc_id"]).count() == 0
    good = quality.CompressionClassifier().fit([(1, t) for _, t in random_docs(40)] + [(0, "!! " * k) for k in range(20, 60)])
    s = good.scores([random_docs(3, 9)[0][1], "!! " * 33])
    assert s[0] > 0.7 > s[1]
    assert quality.keep_good(edge(spark), good).columns == edge(spark).columns


def test_quality_scores_equal_plain_version(spark):
    import zstandard

    m = quality.CompressionClassifier().fit([(1, t) for _, t in random_docs(40)] + [(0, "!! " * k) for k in range(20, 60)])
    texts = [t for _, t in random_docs(10, 3)] + ["!! " * 500, "", None, "é" * 3000]

    def plain(text):
        raw = (text or "").encode()
        size = []
        for d in (m.good, m.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            size.append(sum(len(c.compress(raw[i : i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE)))
        x = np.array([(size[1] - size[0]) / (len(raw) + quality.EVIDENCE), len(raw) / (len(raw) + quality.EVIDENCE)])
        return 1 / (1 + np.exp(-(((x - m.mean) / m.sd) @ m.weights[:-1] + m.weights[-1])))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_documents(df, m, keep=["doc_id"]).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain(t) for t in texts])


def test_labelled_sample_takes_rows_that_fit(spark):
    from stratiform.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (50 if i % 3 else 10)) for i in range(60)] + [(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (4, 7)], "doc_id long, y int")
    got = labelled_sample(docs, labels, "y", key="doc_id", text="text", mod=4, out=2, per_label=1, max_chars=20)
    assert sorted(y for y, _, _ in got) == [0, 1] and all(len(t) <= 20 and zlib.crc32(k.encode()) % 4 != 2 for _, k, t in got)
    every = labelled_sample(docs, labels, "y", key="doc_id", text="text", mod=4, out=2, per_label=10_000, max_chars=99)
    assert {int(k) for _, k, _ in every} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2} and ("1", "a") in {(k, t) for _, k, t in every}


def test_line_frequency(spark):
    lead = "Subscribe to our daily letter now"
    docs = [(i, f"{lead}\n" + " ".join(f"t{i}x{j}" for j in range(60)), "h") for i in range(30)] + [(100, (lead + "\n") * 12, "h"), (101, lead, "other")]
    out = {r.doc_id: r for r in linefreq.assess(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert out[0].n_common_lines == 1 and out[0].kept and not out[100].kept and out[101].n_common_lines == 0
    m = linefreq.measure("a b c\na b c\n  #|")
    assert m[:5] == (8, 9, 2, 1, 6)
    rows = linefreq.assess(edge(spark)).collect()
    assert len(rows) == len(EDGE) and all(not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert linefreq.assess(edge(spark).where("false")).count() == 0
    common = spark.createDataFrame([("h", linefreq.line_hash(linefreq.normalise(lead)))], "host string, line long")
    left = linefreq.remove_common_lines(spark.createDataFrame(docs, "doc_id long, text string, source string"), common)
    assert left.count() == len(docs) and left.where("doc_id < 50 and text like 'Subscribe%'").count() == 0
    assert left.where("doc_id = 101").first().text == lead and left.where("doc_id = 100").first().text == ""


def test_line_limits(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    passage = " ".join(f"p{j}" for j in range(60)).translate(letters)
    body = lambda i: " ".join(f"t{i}x{j}" for j in range(60)).translate(letters)
    docs = [(i, body(i) + ("\n" + passage if i < 50 else "") + ("\nHome\nOK" if i % 2 else "") + ("\nSee more" if i < 12 else ""), "hot") for i in range(7000)]
    out = {r.doc_id: r for r in linefreq.assess(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert out[49].n_common_lines == 3 and out[48].n_common_lines == 1  # the passage in 50 of 7000 documents; short lines in half of them
    assert out[50].n_common_lines == 0 and out[51].n_common_lines == 2 and out[2].n_common_lines == 2  # one limit for short lines too
    ten = [(i, body(i) + "\n" + passage, "h") for i in range(10)]
    assert linefreq.assess(spark.createDataFrame(ten, "doc_id long, text string, source string")).where("n_common_lines > 0").count() == 0  # exactly the limit

def test_pii(spark):
    t = "mail a.b@c.org, ip 10.0.0.300 and 1.2.3.4, call +1 (743) 555-3824, card 4041 8949 7460 8795? password=25a0bc4376e17c8019 v1.2"
    base = pii.base_spans(t)
    assert [(k, t[a:b]) for k, a, b in base if k != "card"] == [("email", "a.b@c.org"), ("ip", "1.2.3.4"), ("phone", "+1 (743) 555-3824")]
    field = pii.train()
    added = {t[a:b] for k, a, b in pii.merged(base, field.spans([t])[0]) if k == "secret"}
    assert added == {"password=25a0bc4376e17c8019"}
    assert field.spans(["plain words only, in 2019 there were 12 of them"]) == [[]]
    rows = pii.find(edge(spark), field).collect()
    assert len(rows) == len(EDGE) and all(r.spans == "" for r in rows if r.doc_id in (1, 2, 3))
    assert pii.find(edge(spark).where("false"), field).count() == 0
    assert pii.mask(t, base).startswith("mail <EMAIL>, ip")
    masked = pii.mask_documents(edge(spark), field)
    assert masked.columns == edge(spark).columns and masked.where("doc_id = 1 and text is null").count() == 1


def test_pii_base_patterns_equal_plain_search():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("a@.1-2 +3025é") for _ in range(r.randint(0, 24)))
        assert [m.span() for m in email.finditer(t)] == list(pii.email_matches(t)), t
        assert [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))] == list(pii.ip_matches(t)), t
    assert list(pii.ip_matches("1.2.3.00999")) == [] and list(pii.ip_matches("1.2.3.00099")) == [(0, 11)] and list(pii.ip_matches("1" * 5000 + ".2.3.4")) == []


def test_pii_takes_linear_time():
    import time

    field = pii.train()
    for t in ("a" * 10**6 + " @", "1" * 10**6 + ".", "1." * 500_000, "a.b@" * 250_000, "@a." * 300_000, "+1" + " " * 10**6, "1.2.3.4 key=a1b2c3d4 " * 40_000):
        begin = time.process_time()
        base = pii.base_spans(t)
        assert time.process_time() - begin < 2, t[:9]
        begin = time.process_time()
        pii.mask(t, pii.merged(base, field.spans([t])[0]))
        assert time.process_time() - begin < 20, t[:9]


def test_pii_merge_equals_plain():
    r = random.Random(5)
    spot = lambda k: (k, a := r.randint(0, 40), a + r.randint(1, 6))
    for _ in range(3000):
        base, added = [spot("ip") for _ in range(r.randint(0, 5))], [spot("secret") for _ in range(r.randint(0, 4))]
        want = [s for s in added if not any(s[1] < e and b < s[2] for _, b, e in base)]
        assert [s for s in pii.merged(base, added) if s[0] == "secret"] == sorted(want, key=lambda s: s[1:]) or len({s[1] for s in want}) < len(want)


def test_pii_leaves_repeated_words_alone():
    field = pii.train()
    for t in ("de " * 60, "at " * 60, "erthin.ced " * 30, "Es, " * 40, "look at us at it at de"):
        assert field.spans([t]) == [[]], t


def test_pii_without_digit_or_at():
    field = pii.train()
    found = lambda t: [(k, t[a:b]) for k, a, b in field.spans([t])[0]]
    assert found("write to john at example dot com today") == [("email", "john at example dot com")]
    assert found("it is password=hunter now") == [("secret", "password=hunter")]
    assert found("token ghp_abcdEFGHijklMNOPqrstUVWXyzabCDEFghij") == [("secret", "ghp_abcdEFGHijklMNOPqrstUVWXyzabCDEFghij")]
    for t in ("look at the dot on the map", "the password is required for all", "key to success; secret garden", "we met at noon"):
        assert found(t) == []


def test_pii_path_is_that_of_whole_texts():
    field, r = pii.train(), random.Random(4)
    words = " ".join(pii.small_labelled_table()["text"]).split() + ["Été,", "ñandú", "İx", "x²", "中文", "CamelCase"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(60)]
    whole = [[y for run in pii.runs(t) for y in field.viterbi([[pii.features(w, b, bb, a) for w, _, b, bb, a in run]])[0]] for t in texts]
    for t, ys, got in zip(texts, whole, field.labels([t.split() for t in texts]), strict=True):
        assert [got.get(i, 0) for i in range(len(ys))] == ys, t


def test_viterbi_equals_brute_force():
    from itertools import product

    f = pii.train()
    seqs = [[pii.features(w, b, bb, a) for w, _, b, bb, a in run] for t in pii.small_labelled_table()["text"][:40] for run in pii.runs(t) if len(run) <= 3]
    for s, got in zip(seqs, f.viterbi(seqs), strict=True):
        u = f._scores(f._encode([s])[0])[0]
        best = max(product(range(len(pii.LABELS)), repeat=len(s)), key=lambda y: sum(u[i, k] for i, k in enumerate(y)) + sum(f.pair[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert list(best) == got


def test_label_model_finds_the_classes():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.2
    kind = r.integers(0, 2, 4000)
    rates = [((0.8, 0.02), 0), ((0.6, 0.03), 0), ((0.7, 0.01), 0), ((0.8, 0.01), 1), ((0.7, 0.02), 1), ((0.6, 0.01), 1)]
    votes = np.stack([np.where(y & (kind == k), r.random(4000) < a, r.random(4000) < b) for (a, b), k in rates] + [r.random(4000) < 0.1], 1).astype(float)
    m = toxicity.LabelModel().fit(votes, weak=1)
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.95
    assert len(m.size) == 3 and abs(np.sort(m.rate[:, 0])[-1] - 0.8) < 0.1
    assert m.accuracy[0] > 0.8 > 0.4 > m.accuracy[-1]
    none = toxicity.LabelModel().fit(np.zeros((5, 4)))
    assert (none.posterior(np.zeros((5, 4))) == 0).all()


def test_label_model_sees_no_label():
    rows = [(k % 2, f"text {k} " + " ".join(f"w{(k * 7 + j) % 90}" for j in range(30)) + (" idiot you moron" if k % 4 == 1 else "")) for k in range(200)]
    one = toxicity.ToxicityModel().fit(rows)
    votes = one.voters.features([t for _, t in toxicity.different_rows(rows)])[:, : one.voters.n]
    again = toxicity.LabelModel().fit(votes, weak=2)
    assert np.array_equal(again.posterior(votes), one.labels.posterior(votes))


def test_toxicity_scores_equal_plain_version(spark):
    docs = random_docs(80)
    rows = [(i % 2, t + (" scum loser idiot" if i % 2 else "")) for i, t in docs]
    m = toxicity.ToxicityModel().fit(rows)
    texts = [t for _, t in rows[:20]] + ["you are trash. GOAWAY, NOBODY", "", None, "idiot " * 9]

    def plain(text):
        words = re.findall(r"[a-z\x80-\xff']+", (text or "").lower().encode().decode("latin-1"))
        words = [w.encode("latin-1") for w in words]
        heads = {h for h in m.voters.stems for w in words if any(w[:n] == h for n in toxicity.STEMS)}
        lex = {w for w in words if w in m.voters.lexicon}
        z = m.weights[-1] + sum(m.weights[m.voters.lexicon[w]] for w in lex) + sum(m.weights[m.voters.stems[h]] for h in heads)
        z += m.weights[m.voters.n - 2] * bool(re.search("you are", text or "")) + m.weights[m.voters.n - 1] * ("GOAWAY" in (text or ""))
        n_lex, n_head = sum(w in lex for w in words), sum(any(w[:n] in heads for n in toxicity.STEMS) for w in words)
        z += m.weights[m.voters.n] * np.log1p(n_lex) + m.weights[m.voters.n + 1] * np.log1p(n_head) + m.weights[m.voters.n + 2] * ((n_lex + n_head) * 100 > len(words))
        return 1 / (1 + np.exp(-(np.clip(z, -20, 20) * m.scale[0] + m.scale[1])))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, m, keep=["doc_id"]).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain(t) for t in texts])


def test_toxicity_patterns_vote_on_every_text():
    v = toxicity.Voters()
    on = lambda t: {v.names[i] for i in v.votes(t)[0]}
    assert on("you are no good") == {"aimed"} and on("GOAWAY, NOBODY wants that") == {"shout_near"}
    assert on(None) == on("") == on("a plain text") == set()
    assert on("Trash, you are an IDIOT") == {"trash", "idiot", "aimed"}


def test_tree_marginals_equal_brute_force():
    from itertools import product

    p = html_extract.Page("<body><div><p>a b</p><p>c</p></div><nav><ul><li>x</li></ul></nav></body>")
    forest, n = html_extract.Forest([p]), len(p.tags)
    r = np.random.default_rng(0)
    unary, pair = r.normal(size=(n, 2)), r.normal(size=(2, 2))
    total, want = 0.0, np.zeros((n, 2))
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pair[y[p.parent[i]], y[i]] for i in range(1, n)))
        total += w
        want[np.arange(n), y] += w
    assert np.allclose(forest.marginals(unary, pair)[0], want / total)


def test_html(spark):
    m = html_extract.train()
    page = '<html><head><title>t</title><script>var a="<p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Big &amp; bold</h1><p>First   para\n graph of the text.<p>Second one, with <a href="#">a link</a>.</p><div class="ad">Buy this now</div></article><div class="comments"><h3>Comments</h3><p>Nice article, friend</p></div><footer>&copy; site</footer>'
    assert m.extract([page, None, "", "<p"]) == ["Big & bold\nFirst para graph of the text.\nSecond one, with a link.", "", "", ""]
    held = html_extract.labelled_pages(60, 77)
    ok = n = 0
    for s, gold in held:
        t = html_extract.Page(re.sub(r' data-c="[01]"', "", s))
        node, _ = html_extract.Forest([t]).marginals(m._unary(t.features()), m.pair)
        ok, n = ok + ((node[:, 1] > 0.5) == np.array(gold)).sum(), n + len(gold)
    assert ok / n > 0.98
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string")
    rows = html_extract.extract(pages, m, keep=["page_id", "url"]).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows)
    assert html_extract.extract(pages.where("false"), m, keep=["page_id", "url"]).count() == 0


def test_html_keeps_what_follows_unclosed_elements():
    m = html_extract.train()
    say = "the words of a long paragraph in the article that goes on for a while."
    text = lambda x: m.extract([f"<html><body><article><h1>Title here</h1><p>First {say}</p>{x}<p>Last {say}</p></article><footer>&copy; site</footer></body></html>"])[0]
    plain = f"Title here\nFirst {say}\nLast {say}"
    for x in ("<svg><path d='M0'>", "<video src='a'>", "<select><option>one", "<object data='x'>", "<noscript>", "<svg><text>gone</text></svg>", "<video><p>gone</p></video>", "<noscript><p>gone</p></noscript>", "<select><option>gone</select>"):
        assert text(x) == plain, x
    assert "Sum x=2 holds." in text("<p>Sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>")
    assert "kept <b>raw</b>" in text("<xmp>kept <b>raw</b></xmp>")


P = "The town council met on Tuesday to talk about the new bridge, which will cost more than was planned at first."
Q = "Engineers said that the old one can carry cars for ten more years, but not the heavy lorries that cross it every day."
WRITTEN = {
    "main": (f"<body><nav><a href='/'>Home</a> <a href='/n'>News</a></nav><main><section><h2>A new bridge</h2><p>{P}</p><ol><li>First a survey.</li></ol><p>{Q}</p></section></main><aside><h3>Popular</h3><ul><li><a href='/1'>One</a></li></ul></aside><footer>&copy; 2024 The Paper</footer></body>", f"A new bridge\n{P}\nFirst a survey.\n{Q}"),
    "table layout": (f"<table><tr><td class='sidebar'><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta</a></li></ul></td><td class='content'><h1>A new bridge</h1><p>{P}</p><p>{Q}</p></td></tr></table>", f"A new bridge\n{P}\n{Q}"),
    "bare body": (f"<html><body><h1>A new bridge</h1><p>{P}</p><p>{Q}</p></body></html>", f"A new bridge\n{P}\n{Q}"),
    "nested boxes": (f"<body><div class='page'><div class='header'><div class='logo'>The Paper</div><div class='nav'><ul><li><a href='/'>Home</a></li></ul></div></div><div class='row'><div class='col'><div class='article-body'><h1>A new bridge</h1><div><div><p>{P}</p></div></div><div class='advert'><p>Buy now, only today!</p></div><p>{Q}</p></div></div><div class='col sidebar'><div class='widget'>Follow us</div></div></div><div id='comments'><div class='comment'><p>I like this bridge a lot, it is a good plan.</p></div></div><div class='cookie-banner'>We use cookies</div></div></body>", f"A new bridge\n{P}\n{Q}"),
    "loose text": (f"<body><div id='content'><h3>A new bridge</h3>{P}<br><br>{Q}</div><div id='footer'>Imprint</div></body>", f"A new bridge\n{P} {Q}"),
    "article with head and foot": (f"<body><article><header><h1>A new bridge</h1></header><p>{P}</p><p>{Q}</p><footer>Tags: <a href='/t'>bridge</a></footer></article><section id='comments'><p>Nice one, this was worth reading to the end.</p></section></body>", f"A new bridge\n{P}\n{Q}"),
}


@pytest.mark.parametrize("name", sorted(WRITTEN))
def test_html_of_written_pages(name):
    source, want = WRITTEN[name]
    assert html_extract.train().extract([source]) == [want]


def test_html_quotes():
    m = html_extract.train()
    p = "the words of a long paragraph in the article that goes on for a while."
    text = lambda x: m.extract([f"<html><body><article><h1>Title here</h1>{x}<p>Last {p}</p></article></body></html>"])[0]
    for tag in ('<p class="x>', "<p title=it's>", "<p class='x>", '<p "odd">', '<p a = "b>c">'):
        got = text(f"{tag}First {p}</p>")
        assert got == f"Title here\nFirst {p}\nLast {p}", tag
    long = "<p>" + "xyzzy " * 300_000 + "</p>"
    assert text(long).count("xyzzy") == 300_000
    assert text("<div>" * 20 + f"<p>First {p}</p>").startswith(f"Title here\nFirst {p}") and isinstance(text("<div>" * 20_000 + p), str)


def test_columns_with_the_names_used_inside(spark):
    extra = ["_text", "_TEXT2", "_h", "_g", "_stays", "_lines", "_html", "_score", "_d0", "_block", "host", "line", "grp", "payload", "w", "term", "worker", "odd name"]
    df = edge(spark).where("doc_id is not null").withColumns({c: F.lit(1) for c in extra})
    cols = df.columns
    model = quality.CompressionClassifier().fit([(1, t) for _, t in random_docs(40)] + [(0, "!! " * k) for k in range(20, 60)])
    assert quality.keep_good(df, model, threshold=0.0).columns == cols and quality.keep_good(df, model, threshold=0.0).count() == df.count()
    keep = ["doc_id", "_text", "odd name"]
    assert langid.identify(df, langid.train(df), keep=keep).columns == [*keep, "lang_pred", "score"]
    assert toxicity.score_documents(df, toxicity.ToxicityModel().fit([]), keep=keep).count() == df.count()
    assert html_extract.extract(df, html_extract.train(), html="text", keep=["doc_id", "_html"]).count() == df.count()
    assert ngram_join.one_of_each(df).columns == cols and ngram_join.join(df).count() == df.count()
    bench = spark.createDataFrame([(1, "never there")], "item_id long, text string")
    assert decontam.keep_clean(df, bench).columns == cols and decontam.keep_clean(df, bench).count() == df.count()
    common = spark.createDataFrame([("a", linefreq.line_hash("x"))], "host string, line long")
    assert linefreq.remove_common_lines(df, common).columns == cols and linefreq.assess(df).count() == df.count()
    assert pii.mask_documents(df, pii.train()).columns == cols
    assert sharding.assign(df).count() == packing.pack(df).select("doc_id").distinct().count() + 1  # doc_id 4 comes twice


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.queries()[name](spark, D)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_pipeline_equals_plain_version(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    rows = [r for r, s in zip(rows, model.scores([t for _, t in rows]), strict=True) if s >= 0.7]
    comp = plain_components(rows)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {x[0] for x in plain_decontamination(rows, items) if x[4]}
    rows = [r for r in rows if r[0] not in bad]
    field = pii.train()
    rows = [(i, pii.mask(t, pii.merged(pii.base_spans(t), field.spans([t])[0]))) for i, t in rows]
    out = corpus_pipeline.run(spark, D).collect()
    assert len({n for n, _ in corpus_pipeline.STAGES}) == 5
    assert {r.doc_id for r in out} == {i for i, _ in rows}
    check_packing(out, rows, packing.Encoder())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_pipeline_on_edges(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    cols = docs.columns
    one = docs.orderBy("doc_id").limit(120)
    odd = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, None), (6, ""), (7, texts[4] + " mail joe@site.org"), (None, "word " * 40_000)]
    more = spark.createDataFrame([(i, t, "en", None, None) for i, t in odd], docs.select(cols).schema).withColumn("_text", F.lit("x"))
    every = one.withColumn("_text", F.lit("y")).unionByName(more, allowMissingColumns=True)
    every.write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    rows = [(r.doc_id, r.text) for r in every.collect()]
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = [r for r, s in zip(rows, model.scores([t for _, t in rows]), strict=True) if s >= 0.7]
    comp = plain_components([(i, t) for i, (_, t) in enumerate(rows)])
    groups = {}
    for i, (n, c) in comp.items():
        groups.setdefault(c if n else ("alone", i), []).append(rows[i])
    first = lambda g: (min((k for k, _ in g if k is not None), default=None), {t for _, t in g})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{d}/documents.parquet"), d), d)
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len(got) == len(groups)
    open_groups = [first(g) for g in groups.values()]
    for k, t in got:
        hit = next(g for g in open_groups if g[0] == k and t in g[1])
        open_groups.remove(hit)
    bad = [x[4] for x in (plain_decontamination([r], items)[0] for r in got)]
    kept = [r for r, b in zip(got, bad, strict=True) if not b]
    clean = corpus_pipeline.decontamination(spark, left, d)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(kept, key=str)
    out = corpus_pipeline.run(spark, d)
    assert out.where("start = 0").count() == len(kept)
    assert out.where("start = 0 and doc_id is null").count() == sum(k is None for k, _ in kept)
    spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, d).count() == 0
