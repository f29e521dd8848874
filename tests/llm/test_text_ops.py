"""Decontamination, toxicity, secrets and token files against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

from docjobs.llm import decontam, secrets, token_files, toxicity, toxicity_features
from docjobs.llm.common import shared_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for p in range(len(w) - n + 1):
            if n and tuple(w[p : p + n]) in wins:
                hit |= set(range(p, p + n))
                found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def corpus():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "naïve", "x1"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 4, 5, 7, 9, 10, 11, 25, 40])))) for i in range(25)] + [(90, None), (91, " -- "), (3, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for i in range(120):
        parts = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            v = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(v) - 1))
            at = rnd.randint(0, len(parts))
            parts[at:at] = v[a : a + rnd.randint(1, 40)]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(parts).upper() if i % 5 == 0 else " ".join(parts), "en"))
    return docs + [(200, None, "en"), (201, "", "en"), (202, "...", "en"), (203, "w1 " * 30_000, "en"), (5, docs[5][1], "en")], items


def test_contamination(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, words string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, occurrences = decontam.contamination(df, bench)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in found.collect())
    want = sorted((i, n, h, len(f), f) for i, t, _ in docs for n, h, f in [brute(t, items)])
    assert got == want
    assert {r.item_id for r in occurrences.select("item_id").distinct().collect()} == {int(x) for w in want for x in w[4]}
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[2]]


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(docs.filter("false"), bench)[0].count() == 0
    assert [tuple(r)[2:5] for r in decontam.contamination(docs, bench.filter("false"))[0].collect()] == [(2, 0, 0)]


def test_word_hashes_tell_words_apart():
    texts = [b"ab c", b"a bc", b"", b"abc", b"AB C"]
    w = decontam.Words(texts)
    h = [tuple(w.hash[w.doc == d].tolist()) for d in range(5)]
    assert h[0] == h[4] and len(set(h)) == 4 and w.count.tolist() == [2, 2, 0, 1, 2] and w.text(0, 2) == "ab c"


SECRETS = [
    'password = "hunter2hunter"', "PASSWD:abc", "Token=abcdef", "api-key: x", "apikey=ABCDEF12", "API_KEY='zzzzzzzz'", "ſecret=abcdefg", "secret = token = abcdefgh", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "xAKIAAKIA" + "9" * 20,
    "0123456789abcdef01234567", "0123456789abcdef0123456", "é" * 5 + " token: aaaaaaaa " + "f" * 50, "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "", None, "clean text",
]
BASE = [("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def test_secrets(spark):
    texts = [*SECRETS, "\n".join(x or "" for x in SECRETS), "ab " * 20_000 + SECRETS[0], SECRETS[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), n, k, m.end()) for n, (k, p, g, least) in enumerate(BASE) for m in re.finditer(p, t or "") if len(m[g]) >= least]
        assert [s for s in got[i] if s[0] in ("assign", "access", "hex")] == [(k, a, z) for a, _, k, z in sorted(want)], t
    assert any(s[0] == "github" for s in got[14]) and any(s[0] == "pem" for s in got[15]) and any(s[0] == "jwt" for s in got[16])
    assert secrets.find_secrets(df.filter("false")).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", "aki", "kia")
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is True
    assert secrets.trigram_query(r"(abc|de)x") == ("or", ("and", "abc", "bcx"), "dex")
    assert secrets.trigram_query(r"abcd?e") == ("or", ("and", "abc", "bcd", "cde"), ("and", "abc", "bce"))
    rnd = random.Random(2)
    for pattern in (r"ab[cd]ef|xyz+", r"(foo|bar)?baz\d+", r"k_(live|test)_[a-z]{3}"):
        rx, q = re.compile(pattern), secrets.trigram_query(pattern)
        shard = secrets.Shard(list(secrets.trigrams(q)) or ["zzz"])
        texts = ["".join(rnd.choices(["ab", "c", "ef", "xyz", "foo", "bar", "baz", "1", "k_", "live", "_abc", " "], k=6)) for _ in range(400)]
        kept = set(secrets.postings_of(q, shard.index([t.encode() for t in texts]), np.arange(len(texts))).tolist())
        assert {i for i, t in enumerate(texts) if rx.search(t)} <= kept


def test_rules_beyond_ascii(spark):
    rules = (secrets.Rule("key", "Schlüssel:[a-z]+"), secrets.Rule("any", "Über(?:ß|Kelvin)\\d", any_case=True), secrets.Rule("han", "[日月]本"), secrets.Rule("short", "é"))
    texts = ["x Schlüssel:abc schlüssel:abc", "ÜBERß1 überß2 ÜberKELVIN3 Über\u212aelvin4", "日本 月本 本", "é", "e", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(df, rules).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(k, a, z) for a, _, k, z in sorted((m.start(), n, r.kind, m.end()) for n, r in enumerate(rules) for m in r.compiled.finditer(t or ""))]
    assert len(got[0]) == 1 and len(got[2]) == 2 and got[3] == [("short", 0, 1)]
    assert secrets.trigrams(secrets.trigram_query("üß")) == {"\xc3\xbc\xc3", "\xbc\xc3\x9f"}


def test_token_files(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Hello, world.\nNew line", "a  b \t c", "", None, "naïve ñandú. ok, x.\n\nq", " lead", "end ", "don't", "<|endoftext|> x", "a\x1cb", "日本語 text.", "word " * 5000, "Hello, world.\nNew line"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "z"), (95, "again")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(4)
    folder = shared_dir(spark, "test")
    manifest = token_files.write_token_files(df, folder, path, shard_bytes=40)
    assert len(manifest["shards"]) >= 6
    for f in token_files.Flat(folder, manifest["shards"][0]["shard"] + ".off", "<i8"), np.memmap(folder.removeprefix("file://") + f"/{manifest['shards'][0]['shard']}.off", "<i8"):
        assert f[0:1].tolist() == [0] and len(f) == manifest["shards"][0]["docs"] + 1 and f[0 : len(f)][-1] == manifest["shards"][0]["tokens"]
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows if i != 95}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id != 95:
            ids = want[r.doc_id]
            assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert manifest["tokens"] == at and len(got) == len(rows)
    empty = shared_dir(spark, "test")
    assert token_files.write_token_files(df.filter("false"), empty, path)["shards"] == [] and token_files.read_token_files(spark, empty).count() == 0


def labelled(spark, n=600):
    rnd = random.Random(8)
    plain = [f"{a}{b}" for a in ("ler", "min", "tor", "vas", "quo", "ped") for b in ("a", "en", "is", "um", "ol")]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        w = rnd.choices(plain, k=rnd.randint(5, 150))
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["zorgum", "zorgite", "idiot", "blixet"]))
        rows.append((i, " ".join(w), "src"))
        labels.append((i, int(toxic)))
    extra = [(n, None, "s"), (n + 1, "", "s"), (n + 2, "idiot " * 20_000, "s"), (n + 3, rows[0][1], "s")]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (0, labels[0][1]), (1, None), (10**6, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    truth = dict(map(tuple, labels.filter("toxic is not null and doc_id < 600").collect()))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(out[i].predicted == truth[i] for i in held) / len(held) >= 0.95
    assert out[600].predicted == 0 and out[601].predicted == 0 and out[602].predicted == 1 and out[603].score == out[0].score
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.filter("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_toxicity(docs.filter("false"), labels).count() == 0


def test_toxicity_features():
    lex = toxicity_features.Lexicon({"zorg": 3.0})
    f = dict(zip(toxicity_features.FEATURES, toxicity_features.features("You IDIOT! zorgum 1d10t i.d.i.o.t anidiot", lex)))
    assert f["insults"] > 0 and f["learned"] > 0 and f["near_you"] > 0 and f["capital_words"] > 0 and f["leet_hits"] > 0 and f["spaced_hits"] == 1 and f["exclamations"] > 0
    assert toxicity_features.features(None, lex) == toxicity_features.features("", lex) and not any(toxicity_features.features("", lex))
