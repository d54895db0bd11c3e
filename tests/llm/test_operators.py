"""Operators against brute force on small, awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from sliceframe.llm import chat, cotraining, decontaminate, license_rules, mixing, ngram_join, pii, quality_rules, substring_dedup, tokens

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "cc", "by", "x$$$"]
    base = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(12)]
    texts = base + base[:4]
    for t in base[:8]:  # near copies
        w = t.split()
        w[rng.randrange(80)] = "edit"
        texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{rng.choice(base)[:80]} {passage} tail{i}" for i in range(5)]
    texts += [None, "", " \t\n", "a b c", "A B c", "one", "all rights  reserved CC-by general public\nlicense", "mail bob.b@ex-1.example.com or +1 (743) 555-3824, 4465758382889437 at 8.196.197.208 999.1.1.1"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", 0, "z") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[20], (None, "null id here", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_pii_base_spans():
    rng = random.Random(1)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5000):
        t = "".join(rng.choice("a@.-1+ 4(2)b5%_@.") for _ in range(rng.randint(0, 40)))
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(t) if s[0] in ("email", "ip")] == want


def test_pii_query(docs):
    got = {r["doc_id"]: r for r in rows(pii.query(docs))}
    assert len(rows(pii.query(docs))) == docs.count()
    last = max(k for k in got if k is not None)
    assert [got[last][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pii_disclosing_terms(spark):
    texts = [f"{i} filler words here; secretname wrote to ann@corp.example.com today" for i in range(4)] + [f"plain text {i} of other words" for i in range(600)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = {r["doc_id"]: r["text"] for r in rows(pii.stage(spark, d))}
    assert "secretname" not in done[0] and "ann@" not in done[0] and done[10] == texts[10]


def test_pii_copies_are_no_counter_evidence(spark):
    texts = [f"{i} filler words; secretname wrote to ann@corp.example.com today" for i in range(3) for _ in range(40)] + [f"plain text {i} of other words" for i in range(900)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    done = rows(pii.stage(spark, d))
    assert len(done) == len(texts) and not any("secretname" in r["text"] for r in done)


def test_pii_terms_without_their_entity(spark):
    texts = [f"{i} filler words; secretname wrote to ann@corp.example.com today" for i in range(30)] + ["Later Secretname left."] + [f"plain text {i} of other words" for i in range(2500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = {r["doc_id"]: r["text"] for r in rows(pii.stage(spark, d))}
    assert done[30] in ("Later  left.", "Later [TERM] left.") and done[40] == texts[40]
    assert {r["doc_id"]: r["n_terms"] for r in rows(pii.query(d))}[30] == 1


def test_pii_terms_of_any_form_and_place(spark):
    pad = " ".join(f"u{k}" for k in range(300))
    texts = [f"account jdoe47 {pad} \u201cBl\u00e4ulich\u201d mail ann@corp.example.com end" for _ in range(1)]
    texts += [f"{i} account jdoe47 {pad} \u201cBl\u00e4ulich\u201d mail ann@corp.example.com end" for i in range(3)]
    texts += [f"{i} hotdesk write to desk@hot.example.org" for i in range(100)]  # more than 1 of 64
    texts += [f"{i} widgetmakers p{i}@widget.example.net" for i in range(5)]  # each address once, one domain
    texts += [f"account {pad} mail end write to plain {i} words" for i in range(1500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = {r["doc_id"]: r["text"] for r in rows(pii.stage(spark, d))}
    assert not any(w in t for t in done.values() for w in ("jdoe47", "Bl\u00e4ulich", "hotdesk", "widgetmakers"))
    assert done[len(texts) - 1] == texts[-1]
    assert pii.words_of().findall("\u201cA1\u0301\u201d_b\u2014c") == ["A1\u0301", "b", "c"]


def test_license_phrases(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in rows(license_rules.query(docs))}
    for i, t, *_ in corpus():
        w = word.findall((t or "").translate(LOWER))
        at = sorted((k, label) for p, label in license_rules.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))


def samples(parsed):
    """Texts that a parsed pattern matches: each branch, each optional part with and without."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [" " if "CATEGORY_SPACE" in str(arg) else chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])]
        elif op == "SUBPATTERN":
            more = samples(arg[3])
        elif op == "BRANCH":
            more = [x for b in arg[1] for x in samples(b)]
        elif op == "ANY":
            more = ["x"]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [x * n for x in samples(arg[2]) for n in {arg[0], max(arg[0], 1)}]
        else:  # boundaries and looks around
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
            more = [""]
        out = [a + b for a in out for b in more]
    return sorted(set(out))


def test_license_prefilters_lose_no_match():
    from re import _parser

    for kw, pattern, label, _ in license_rules.rules():
        found, rule = 0, re.compile("(?i)" + pattern)
        assert " " not in kw
        for t in samples(_parser.parse(pattern)):
            cuts = [m.start() for m in re.finditer(" ", t)]
            for w in [t, t.replace(" ", "\n"), t.replace(" ", "\n  "), t.upper(), *(t[:i] + "\n" + t[i + 1 :] for i in cuts)]:
                for glued in (w, f"x{w}", f"{w}x", f"x{w}x"):
                    if rule.search(glued):
                        found += 1
                        words = re.split("[^a-z0-9]+", glued.lower())
                        assert kw[1:] in glued.lower() if kw[0] == "*" else kw in words, (kw, label, glued)
        assert found, pattern


def test_license_wrapped_texts(spark):
    texts = {"This work is under Creative Commons Zero.": "cc0", "released into the public\ndomain": "public-domain", "dedicated to the\npublic domain": "public-domain", "some rights\nreserved": "reserved", "Permission is\nhereby granted, free of charge, to any person obtaining a copy": "mit", "Redistribution\nand use in source and binary forms, with or without modification": "bsd", "You may not\nuse this file except in compliance with the License": "apache-2.0"}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in rows(license_rules.query(d))} == dict(enumerate(texts.values()))


def test_license_suppression(spark):
    d = spark.createDataFrame([(0, "SPDX-License-Identifier: MIT\nLicensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    hits = license_rules.scan(d).select("license.detections").first()[0]
    assert {h["label"] for h in hits} == {"mit", "apache"} and len(license_rules.rules()) > 200
    assert all(not (a is not b and a["start"] <= b["start"] and a["neg_end"] <= b["neg_end"] and a["prio"] <= b["prio"]) for a in hits for b in hits)


def brute_repeats(texts):
    where = Counter()
    split = [(t or "").encode().split() for t in texts]
    for w in split:
        where.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - 34):
            if where[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_substring_dedup(docs):
    data = corpus()
    want = Counter((d[0], *x) for d, x in zip(data, brute_repeats([d[1] for d in data])))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.query(docs)))
    assert got == want


def test_substring_dedup_periodic_and_split_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 1)
    core = [f"c{i}" for i in range(40)]
    texts = ["x " * 60, " ".join(core), " ".join(["q1", *core, "q2"]), " ".join(["q3", *core[:36], "q4"]), " ".join(f"u{i}" for i in range(50))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, *x) for i, x in enumerate(brute_repeats(texts))}
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.query(d))} == want


def test_suffix_automaton_counts():
    rng = random.Random(5)
    for _ in range(50):
        seqs = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        sa = substring_dedup.SuffixAutomaton([(s, 1) for s in seqs])
        n = Counter(tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2))
        for s in seqs:
            want = sum(1 << i for i in range(len(s) - 2) if n[tuple(s[i : i + 3])] > 1)
            assert sa.repeated(s, 3) == want


def test_chat_round_trip(spark):
    hard = ["\\p|", "<|end|>\n", "<|more|>", "\\", "|", "", None, "a<", "\\\\p"]
    data = [(c, k, r, t) for c in (1, 2) for k, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "u|\\s", "end", None, "assistant", "user"], hard))]
    data += [(None, 0, "user", "x"), (None, 0, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).select("conv_id", chat.read_back(chat.F.col("formatted")).alias("t"), chat.loss_text(chat.F.col("segments")).alias("loss"))
    by = {r["conv_id"]: r for r in got.collect()}
    assert [(x["role"], x["text"]) for x in by[1]["t"]] == [(r or "", t or "") for _, _, r, t in data[:9]]
    assert by[1]["loss"] == "<|more|>\\a<" and len(by[None]["t"]) == 2


def test_tokens_equal_library(docs):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or ""))) for i, t, *_ in corpus())
    got = rows(tokens.query(docs, public.path("piece_bpe_32k.model")))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", " ", "the", "▁", "é", "\n", "漢", "<s>", "\x00", " of"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert tokens.count_texts(odd, tokens.prove(public.path("piece_bpe_32k.model"))) == [len(lib.encode(t)) for t in odd]


def test_quality_statistics_and_rules(spark, docs):
    labels = spark.createDataFrame([(i, 0 if t and "$" in t else 1, 0) for i, t, *_ in corpus() if i is not None and i % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality_rules.query(docs, labels))}
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cov = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(cov), failed)
        assert not (failed and r["kept"])


def test_rules_are_learned(spark):
    rng = random.Random(2)
    good = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(80)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(999)}###" for _ in range(80)), 0) for i in range(60)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    kept = {r["doc_id"]: r["kept"] for r in rows(quality_rules.query(d.select("doc_id", "text"), d.select("doc_id", "quality")))}
    assert all(kept[i] for i in range(150)) and not any(kept[1000 + i] for i in range(60))


def test_cotraining_held_out(spark):
    rng = random.Random(4)
    def row(i):
        q = int(rng.random() < 0.7)
        return (i, " ".join((f"w{rng.randrange(99)}" if q else f"W{rng.randrange(99)}!!") for _ in range(30)), "en", f"s{q if rng.random() < 0.8 else 1 - q}", q)
    d = spark.createDataFrame([row(i) for i in range(600)], "doc_id long, text string, lang string, source string, quality int")
    labels = d.where("doc_id < 150").select("doc_id", "quality")
    got = {r["doc_id"]: r["kept"] for r in rows(cotraining.query(d.drop("quality"), labels))}
    truth = {r["doc_id"]: r["quality"] for r in rows(d)}
    assert sum(got[i] == bool(truth[i]) for i in range(150, 600)) > 0.95 * 450
    none = cotraining.query(d.drop("quality").limit(0), labels)
    assert none.count() == 0


def test_decontamination(spark, docs):
    items = [("i1", " ".join(f"p{i}" for i in range(5, 25))), ("i2", "One!"), (None, None), ("i2", "one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    got = {r["doc_id"]: r for r in rows(decontaminate.query(docs, bench))}
    for i, t, *_ in corpus():
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(13, len(v))
            for j in range(len(v) - n + 1 if v else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == v[j : j + n]:
                        hit |= set(range(a, a + n))
                        ids.add(k or "")
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items_sha256"]) == (len(w), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    blocks = decontaminate.scan(docs.select("doc_id", "text"), bench, max_pattern_bytes=100)
    assert {(r["doc_id"], len(r["decon"]["hits"])) for r in rows(blocks)} == {(k, r["n_hit"]) for k, r in got.items()}


def test_mixing(docs):
    data, got = corpus(), rows(mixing.query(docs))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in data:
        sizes[s] += len((t or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left, total = budget - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: left * weight[s] / total for s in free}
        free -= over or free
    source = {d[0]: d[3] for d in data}
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    longest = max(len((d[1] or "").encode().split()) for d in data)
    assert len(got) == len(data) and all(abs(taken[s] - target[s]) <= longest for s in names)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.query(docs.repartition(5)))))
    mixed = rows(mixing.mix(docs))
    assert sum(r["words"] for r in mixed) == sum(taken.values())


def test_ngram_join(docs):
    data = corpus()
    sets = {}
    for k, (i, t, *_) in enumerate(data):
        w = (t or "").translate(LOWER).encode().split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(data)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            same = data[a][0] is not None and data[a][0] == data[b][0]
            if a < b and (same or (data[a][0] is not None and data[b][0] is not None and both and 100 * both >= 80 * len(sets[a] | sets[b]))):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = defaultdict(list)
    for k, d in enumerate(data):
        if d[0] is not None:
            low[find(k)].append(d[0])
    want = Counter((d[0], len(sets[k]), None if d[0] is None else min(low[find(k)])) for k, d in enumerate(data))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.query(docs))) == want


def test_count_tree_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = rng.poisson(2.0, size=(300, 16))
    counts[150:] = np.maximum(0, counts[:150] + rng.integers(-1, 2, size=(150, 16)) * (rng.random((150, 16)) < 0.1))
    points = np.concatenate([counts.sum(axis=1, keepdims=True), counts], axis=1).astype(np.uint16)
    found = {tuple(sorted(p)) for i, j in ngram_join.CountTree(points).pairs() for p in zip(i.tolist(), j.tolist())}
    for i in range(300):
        for j in range(i + 1, 300):
            n, m, most = int(points[i, 0]), int(points[j, 0]), int(np.minimum(points[i, 1:], points[j, 1:]).sum())
            if 100 * most >= 80 * (n + m - most) and 100 * min(n, m) >= 80 * max(n, m):
                assert (i, j) in found


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (pii.query(d), license_rules.query(d), substring_dedup.query(d), quality_rules.query(d, labels), decontaminate.query(d, bench), mixing.query(d), ngram_join.query(d), cotraining.query(d, labels)):
        assert df.count() == 0
    assert all(f(d).count() == 0 for f in (lambda x: pii.stage(spark, x), lambda x: ngram_join.stage(spark, x), lambda x: quality_rules.stage(spark, x, labels), lambda x: decontaminate.stage(spark, x, bench), lambda x: mixing.stage(spark, x)))
    conversations = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(conversations).count() == 0 and chat.query(conversations).count() == 1


def test_ngram_join_dealt_in_chunks(spark, monkeypatch):
    """Salts, chunks of hot blocks and clusters, trees, folded points: on a group of near copies that only chains join."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    monkeypatch.setattr(ngram_join, "CHUNK", 1500)
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "FAN", 2)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "SALT_RANK", 20)
    monkeypatch.setattr(ngram_join, "FULL", 64)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(130)]
    texts = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(130)] = f"e{rng.randrange(9)}"
        texts.append(" ".join(w))
    common = " ".join(f"c{i}" for i in range(30))
    texts += [common + " " + " ".join(f"u{i}x{j}" for j in range(rng.randint(5, 60))) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [ngram_join.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if ngram_join.word_sets_linked(texts[i].encode().split(), texts[j].encode().split()):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.query(d))}
    assert got == dict(enumerate(root)) and len(set(root)) > 40
    assert [len(x) for x in sets[:2]] == [126, 126]
    x = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert ngram_join.groups_of(200) > ngram_join.GROUPS
    assert (ngram_join.unpack_point(ngram_join.point(x), 200, ngram_join.GROUPS) == np.bincount((x % np.uint64(ngram_join.GROUPS)).astype(int), minlength=ngram_join.GROUPS)).all()


def test_components_of_a_long_chain(spark):
    from sliceframe.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(components(edges))}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def cotraining_rows(n=500):
    rng = random.Random(4)
    def row(i):
        q = int(rng.random() < 0.7)
        t = " ".join((f"w{rng.randrange(99)}" if q else f"W{rng.randrange(99)}!!") for _ in range(rng.randint(3, 30)))
        return (i, t, rng.choice(["en", None]), f"s{q if rng.random() < 0.8 else 1 - q}", q)
    out = [row(i) for i in range(n)]
    out += [(n + k, *out[300 + k % 5][1:]) for k in range(150)]  # copies
    return out + [(n + 200, None, None, None, 1), (n + 201, "", None, "", 0), (None, "x", "en", "s0", 0), out[3], out[400]]


def test_cotraining_equals_plain_numpy(spark):
    import numpy as np

    data = cotraining_rows()
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, quality int")
    labels = d.where("doc_id < 150").select("doc_id", "quality")
    docs = d.drop("quality")
    add = 12
    hashed = {r["doc_id"]: r for r in d.select("doc_id", cotraining.F.xxhash64(cotraining.F.lit(5), "doc_id").alias("h"), cotraining.F.pmod(cotraining.F.xxhash64(cotraining.F.lit(6), "doc_id"), cotraining.F.lit(4)).alias("fold")).distinct().collect()}
    view = lambda r: cotraining.views_of(None if r[1] is None else r[1].encode(), r[2], r[3])
    known = sorted({r[0]: r for r in data if r[0] is not None and r[0] < 150}.values(), key=lambda r: (hashed[r[0]]["h"], r[0]))
    y = np.array([float(r[4]) for r in known])
    views = [np.stack([view(r)[v] for r in known]) for v in (0, 1)]
    held = np.array([hashed[r[0]]["fold"] == 3 for r in known])
    train = [(v[~held], y[~held]) for v in views]
    share = y.mean()
    bad = min(add - 1, max(1, round(add * (1 - share))))
    free = {}
    for r in data:  # one row for each different pair of views
        if r[0] is not None and r[0] >= 150:
            x = view(r)
            k = np.concatenate(x).astype("<f4").tobytes()
            free[k] = min(free.get(k, (1 << 70, 0, None)), (hashed[r[0]]["h"], r[0], k))
    for _ in range(4):
        models = [cotraining.fit_logistic(*t) for t in train]
        new = {0: [], 1: []}
        for v in (0, 1):
            scored = []
            for k, (h, i, _x) in free.items():
                x = np.frombuffer(k, dtype="<f4").astype(float)
                x = (x[:512], x[512:])
                scored.append((cotraining.log_odds(x[v], models[v]), h, i, x, k))
            for side, count in ((True, bad), (False, add - bad)):
                best = sorted((s for s in scored if abs(s[0]) > 1 and (s[0] < 0) == side), key=lambda s: (-abs(s[0]), s[1], s[2]))[:count]
                new[v] += [(s[3], 0.0 if side else 1.0, s[4]) for s in best]
        if not any(new.values()):
            break
        for v in (0, 1):
            if new[v]:
                o = 1 - v
                train[o] = (np.vstack([train[o][0], *[x[o][None] for x, _, _ in new[v]]]), np.concatenate([train[o][1], [k for _, k, _ in new[v]]]))
        for v in (0, 1):
            for _, _, k in new[v]:
                free.pop(k, None)
    want = cotraining.combined([cotraining.fit_logistic(*t) for t in train], views, y, held)
    scores = []
    for parts in (1, 3, 7):
        model = cotraining.fit(docs.repartition(parts), labels, add=add)
        for a, b in zip([*model[0], *model[1], model[2]], [*want[0], *want[1], want[2]]):
            assert np.allclose(a, b, atol=1e-9)
        scores.append(sorted(map(str, rows(cotraining.score(docs.repartition(parts), model)))))
    assert scores[0] == scores[1] == scores[2]


NAMES = ["_h", "_g", "_s", "_b", "_q", "_row", "_rank", "_start", "_found", "_terms", "_pii", "_decon", "row", "h", "g", "s", "b", "at", "id", "cid", "n", "comp", "component", "root", "terms", "found", "stats", "verdict", "size", "target", "taken", "words", "copy", "queued", "pii", "decon", "dedup", "hits", "items"]


def test_clashing_names_ties_and_repeated_rows(spark):
    """Each stage and operator keeps columns of any name as they are."""
    base = spark.createDataFrame(corpus(), SCHEMA)
    docs = base.select("*", *[cotraining.F.concat(cotraining.F.lit(f"{c}:"), cotraining.F.coalesce(cotraining.F.col("doc_id").cast("string"), cotraining.F.lit("null"))).alias(c) for c in NAMES])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    bench = spark.createDataFrame([("i", "no such words")], "item_id string, text string")
    done = {
        "pii": pii.stage(spark, docs),
        "decon": decontaminate.stage(spark, docs, bench),
        "quality": quality_rules.stage(spark, docs, labels),
        "join": ngram_join.stage(spark, docs),
        "dedup": substring_dedup.dedup(docs, out="result"),
        "license": license_rules.scan(docs, out="result"),
        "tokens": cotraining.score(docs, 0.5, out="result"),
        "mix": mixing.mix(docs),
    }
    total = docs.count()
    for name, df in done.items():
        new = {"size", "target", "taken", "copy", "words"} if name == "mix" else set()
        assert set(docs.columns) <= set(df.columns), name
        got = rows(df)
        assert all(r[c] == f"{c}:{'null' if r['doc_id'] is None else r['doc_id']}" for r in got for c in NAMES if c not in new), name
        if name in ("pii", "decon", "dedup", "license", "tokens"):
            assert len(got) == total, name
    ids = [r["doc_id"] for r in rows(done["join"]) if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))


def test_very_long_texts(spark):
    """5 MB of words in one text, beside a near copy of it and a short one."""
    rng = random.Random(9)
    w = [f"w{rng.randrange(50_000)}" for _ in range(750_000)]
    near = list(w)
    near[10] = "other"
    texts = [" ".join(w), " ".join(near), "short text"]
    assert len(texts[0]) > 4_500_000
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([("i", " ".join(w[1000:1020]))], "item_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in rows(ngram_join.query(d))} == {0: 0, 1: 0, 2: 2}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in rows(decontaminate.query(d, bench))} == {0: (750_000, 20), 1: (750_000, 20), 2: (2, 0)}
    assert {r["doc_id"]: r["n_removed"] for r in rows(substring_dedup.query(d))} == {0: 750_000 - 11, 1: 750_000 - 11, 2: 0}
    assert {r["doc_id"]: r["size"] for r in rows(mixing.query(d))} == {0: 750_000, 1: 750_000, 2: 2}
    assert {r["doc_id"]: r["n_words"] for r in rows(license_rules.query(d))} == {0: 750_000, 1: 750_000, 2: 2}
    assert [r["n_words"] for r in sorted(rows(quality_rules.query(d, labels)), key=lambda r: r["doc_id"])] == [750_000, 750_000, 2]
    assert len(rows(pii.query(d))) == len(rows(cotraining.query(d, labels))) == 3


def test_pii_cards_phones_and_digest():
    """Card and phone patterns against their plain reading, and the digest of the spans."""
    rng = random.Random(6)
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def passes(digits):
        doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0

    hits = 0
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789012345678901234567 -+().a") for _ in range(rng.randint(10, 40)))
        only = lambda m: re.sub("[^0-9]", "", m[0])
        want = [("card", *m.span()) for m in card.finditer(t) if passes(only(m))] + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(only(m)) <= 15]
        assert [s for s in pii.base_spans(t) if s[0] in ("card", "phone")] == want
        hits += len(want)
    assert hits > 500


def test_quality_counts_and_learned_list(spark):
    """The remaining counts by brute force; the learned list gives what its rules say."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(400)}" + ("!" if i % 3 == 0 else "") for _ in range(60)) + ("\nline # one\nline # one\n \n \n" if i % 4 == 0 else "") for i in range(120)]
    d = spark.createDataFrame([(i, t, int(i % 3 != 0)) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    rules = quality_rules.fit(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    assert rules
    got = {r["doc_id"]: r for r in rows(quality_rules.query(d.select("doc_id", "text"), d.select("doc_id", "quality")))}
    for i, t in enumerate(texts):
        w, lines, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t)), dup)
        chars = sum(map(len, w))
        values = {"mean_word": chars / len(w), "symbol_share": r["n_symbols"] / len(w), "dup_line_share": dup / len(seen | {0}) if not seen else dup / sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines), "repeat_share": r["n_repeat_words"] / len(w), "upper_share": sum(c.isascii() and c.isupper() for c in t) / chars, "shout_share": (t.count("!") + t.count("?")) / len(w), "digit_share": sum(c in "0123456789" for c in t) / chars, "log_words": __import__("math").log(1 + len(w))}
        rejected = any(all(values[f] >= c if op == ">=" else values[f] < c for f, op, c in rule) for rule in rules)
        assert r["kept"] == (not r["base_failed"] and not rejected), (i, rules, values)
