"""The registered queries over the smallest tables: columns, types and values against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import floor

import __spark_entry__ as entry
import pytest
from annalist.llm import pii, queries, secrets
from tests.llm.test_operators import AZ, brute_components, brute_contamination, brute_dedup, brute_targets, nearest_sum, spaced

COLUMNS = {
    "op1_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_tokens": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint",
    "op7_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark, sf_dir, docs):
    out = {}
    for name, columns in COLUMNS.items():
        df = entry.queries()[name](spark, sf_dir)
        kinds = dict(df.dtypes)
        for c in columns.split(", "):
            n, k = c.split()
            assert kinds[n] == k, (name, n)
        out[name] = {r.doc_id: r for r in df.collect()}
        assert out[name].keys() == docs.keys()
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_mix(docs, results):
    got, size, taken = results["op1_mix"], Counter(), Counter()
    for i, d in docs.items():
        assert got[i].size == len(spaced(d.text)) and got[i].taken in (0, got[i].size, 2 * got[i].size)
        size[d.source] += got[i].size
        taken[d.source] += got[i].taken
    goal = brute_targets(dict(size))
    assert all(got[i].target == float(goal[d.source]) and got[i].source_size == size[d.source] for i, d in docs.items())
    assert all(abs(taken[s] - goal[s]) <= max(40, 0.02 * goal[s]) for s in size)
    for s in size:  # no choice of takes comes nearer
        near = floor(goal[s] + Fraction(1, 2))
        assert abs(taken[s] - near) == nearest_sum(near, [got[i].size for i, d in docs.items() if d.source == s])


def test_substrings(docs, results):
    assert Counter(tuple(r) for r in results["op2_substrings"].values()) == brute_dedup([(i, d.text) for i, d in docs.items()])


def test_pii(docs, results):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    tests = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s).encode()), lambda s: 8 <= len(digits(s)) <= 15]
    for i, d in docs.items():
        spans = [[f"{n}:{m.start()}:{m.end()}" for m in p.finditer(d.text) if ok(m[0])] for n, p, ok in zip(pii.KINDS, (email, ip, card, phone), tests)]
        r = results["op3_pii"][i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans] and r.base_sha256 == sha(",".join(sum(spans, [])))
        assert set(sum(spans, [])) <= set(r.spans.split(","))


def test_toxicity(results):
    for i, r in results["op4_toxicity"].items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_tokens(docs, results):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries._vocabulary())
    for i, d in docs.items():
        n = len(tok.encode(d.text, add_special_tokens=False).ids)
        assert tuple(results["op5_tokens"][i]) == (i, len(d.text.encode()), n, n > 2048)


def test_decontaminate(spark, sf_dir, docs, results):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in results["op6_decontaminate"].values()) == brute_contamination([(i, d.text) for i, d in docs.items()], items, 10)


def test_secrets(docs, results):
    word = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = re.compile("(?:" + "|".join([*map(word, ("password", "passwd", "secret", "token")), word("api") + "_?" + word("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, d in docs.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(d.text) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", d.text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", d.text) if len(m[0]) >= 24]
        base = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        r = results["op7_secrets"][i]
        assert r.base_sha256 == sha(",".join(base)) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)] and set(base) <= set(r.spans.split(",")) | {""}


def test_language_model(docs, results):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*spaced(d.text.translate(AZ)), None] for i, d in docs.items()}
    count = Counter(t for i, ts in tokens.items() if not held(i) for t in ts)
    n, v, gain = sum(count.values()), len(count), 0.0
    for i, ts in tokens.items():
        r = results["op8_lm"][i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ts), sum(t in count for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((count.get(t, 0) + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        gain += (r.score - r.base_score) * held(i)
    assert gain > 0  # held-out texts are likelier under the model than under single words


def test_media(docs, results):
    for i, d in docs.items():
        raw = d.text.encode()
        pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = results["op9_media"][i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))


def test_jaccard(docs, results):
    assert Counter(tuple(r) for r in results["op10_jaccard"].values()) == brute_components([(i, d.text) for i, d in docs.items()])
