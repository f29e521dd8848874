"""The registered queries that have no SQL, called as they are registered, against plain versions of each row."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from docjobs.llm import html_extract, secrets, toxicity, toxicity_features
from docjobs.llm.queries import QUERIES
from tests.llm.test_dedup import classes_of, plain_fingerprint
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, "documents").collect()}


def test_op2(spark, texts):
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{fp:016x}", ids[c]) for i, fp, c in zip(ids, fps, classes_of(fps, 3))}
    out = QUERIES["op2_simhash"](spark, DATA)
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()} == want


def test_op4(spark, texts):
    """Every score from the model's trees and steps by hand; the registered query keeps to its contract."""
    labels = table(spark, "labels")
    model = toxicity.Scorer(table(spark, "documents"), labels)
    got = {r.rest.doc_id: r.score for r in model.score(table(spark, "documents").select("doc_id", "text")).collect()}
    assert set(got) == set(texts)
    if model.constant is None:
        from pyspark.ml.linalg import Vectors

        lexicon = toxicity_features.Lexicon(model.learned)
        for i in sorted(texts)[:60]:
            p = model.trees.predictProbability(Vectors.dense(toxicity_features.features(texts[i], lexicon)))[1]
            want = p
            if model.isotonic is not None:
                step = np.interp(p, np.array(model.isotonic.boundaries.toArray()), np.array(model.isotonic.predictions.toArray()))
                want = min(1 - model.least, max(model.least, step)) + toxicity.TIE * (p - 0.5)
            assert got[i] == pytest.approx(want, abs=1e-9)
    out = QUERIES["op4_toxicity"](spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


BASE = [("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def test_op6(spark, texts):
    out = {r.doc_id: r for r in QUERIES["op6_secrets"](spark, DATA).collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        base = sorted((m.start(), n, m.end(), k) for n, (k, p, g, least) in enumerate(BASE) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        more = [(m.start(), n, m.end(), r.kind) for n, r in enumerate(secrets.RULES) if n >= 3 for m in re.finditer(r.pattern, t or "", re.ASCII)]
        line = lambda spans: ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))
        r, n = out[i], Counter(k for *_, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and r.spans == line(base + more)


class Article(HTMLParser):
    """The blocks of the article of a page as the given ones are built."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.mute, self.blocks = 0, 0, [[]]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.mute += tag in ("script", "style")
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag in html_extract.BLOCKS:
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.mute -= tag in ("script", "style")
        if tag in html_extract.BLOCKS:
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.mute:
            self.blocks[-1].append(data)

    def text(self):
        return "\n".join(t for b in self.blocks if (t := " ".join("".join(b).split())))


def test_op7(spark):
    pages = table(spark, "pages").collect()
    out = {r.page_id: r for r in QUERIES["op7_html_extract"](spark, DATA).collect()}
    assert set(out) == {r.page_id for r in pages}
    for p in pages:
        want = Article(p.html or "").text()
        r = out[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, want, len(want)), p.page_id


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts)


@pytest.mark.parametrize("declared", [True, False])
def test_style_tree_of_the_given_pages(spark, declared):
    """Importance by the definition, from each host's different pages in plain Python."""
    hosts = defaultdict(dict)
    for p in table(spark, "pages").collect():
        name = re.match(r"[a-z]+://([^/:?#]+)", p.url or "")
        page, nodes = html_extract.style_nodes(p.html or "", declared)
        hosts[name[1].lower() if name else ""][page] = nodes
    want = {}
    for name, pages in hosts.items():
        looks, own, branch, kinds, n_pages = defaultdict(Counter), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}, Counter()
        for page, nodes in pages.items():
            for node, kind, style, texts, whole in nodes:
                kinds[node] = kind
                n_pages[node] += 1
                looks[node][style] += 1
                for t in texts:
                    own[node][t].add(page)
                if not texts:
                    branch[node][whole].add(page)
        for node, n in n_pages.items():
            most = math.log(n) if n > 1 else 1.0
            content = lambda held: 1 - sum(math.log(len(x)) for x in held.values()) / len(held) / most if n > 1 else 1.0
            style = entropy(looks[node].values()) / most if n > 1 else 1.0
            want[name, node] = (kinds[node], n, content(own[node]) if own[node] else 1 - (1 - style) * (1 - content(branch[node])))
    got = {(r.host, r.node): (r.kind, r.pages, r.importance) for r in html_extract.style_tree(table(spark, "pages"), declared=declared).collect()}
    assert set(got) == set(want) and {h for h, _ in got} >= {h for h, pages in hosts.items() if any(pages.values())}
    for k, (kind, n, importance) in want.items():
        assert got[k][:2] == (kind, n) and got[k][2] == pytest.approx(importance, abs=1e-9)


def test_op10(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, {}
    for i in sorted(texts):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_files"](spark, DATA).collect()}
    assert got == want
