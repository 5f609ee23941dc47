"""The registered queries over all of sf0.001 against plain versions."""

import binascii
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolog.llm import html_render, queries, secrets, toxicity, weak_labels, winnowing
from tempolog.llm.query_quality import held_out

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op2(spark, docs):
    rows = run(spark, "op2_quality_rules")
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id] or ""
        w = WORD.findall(t)
        lines = t.split("\n")
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {x for x in set(runs) if runs.count(x) > 1} if len(set(runs)) < len(runs) else set()
        hit = {i + j for i, x in enumerate(runs) if x in many for j in range(8)}
        dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and r.kept == (not r.base_failed and r.rule == 0)


def test_op3(spark, docs):
    base = {
        "assign": (r"""(?ai:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
        "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
        "hex": (r"([0-9a-f]+)", 1, 32),
    }
    path = secrets.tokenizer_path()
    encode = secrets._encoding(path).encode_ordinary
    for r in run(spark, "op3_secret_scans"):
        t = docs[r.doc_id] or ""
        found = [(m.start(), i, m.end(), k) for i, (k, (p, g, n)) in enumerate(base.items()) for m in re.finditer(p, t) if len(m[g]) >= n]
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in found) for k in base)
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
            run_ = m[0].strip("=-_/+")
            if len(m[0]) >= 20 and len(run_) >= 20 and not re.fullmatch(r"AKIA[A-Z0-9]+", run_) and not secrets.known(run_) and not secrets.worded(run_, path) and len(run_) / len(encode(run_)) < 2.2:
                more.append((m.start() + m[0].index(run_), 3, m.start() + m[0].index(run_) + len(run_), "random"))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found + more))


def test_op5(spark, docs):
    order = sorted(docs)
    plain = {}
    texts = [(i, docs[i] or "", "") for i in order]
    for n, i in enumerate(order):
        t, after = docs[i] or "", docs[order[(n + 1) % len(order)]] or ""
        plain[i] = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
    own = spark.createDataFrame([(i, docs[i] or "", plain[i]) for i in order], "doc_id bigint, text string, edited string")
    f = {r.doc_id: r for r in own.select("doc_id", winnowing.chosen(F.col("text")).alias("a"), winnowing.chosen(F.col("edited")).alias("b")).withColumns({"da": winnowing.digest(F.col("a")), "db": winnowing.digest(F.col("b"))}).collect()}
    like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
    hashes = lambda a: {x.hash for x in a}
    rows = {r.doc_id: r for r in run(spark, "op5_document_fingerprints")}
    assert set(rows) == set(order) and len(texts) == len(rows)
    for n, i in enumerate(order):
        r, nxt = rows[i], order[(n + 1) % len(order)]
        assert (r.n_chars, r.edited_sha256) == (len(docs[i] or ""), hashlib.sha256(plain[i].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f[i].da, f[i].db)
        assert abs(r.near_edited - like(hashes(f[i].a), hashes(f[i].b))) < 1e-12 and abs(r.near_next - like(hashes(f[i].a), hashes(f[nxt].a))) < 1e-12
        # the guarantee: 23 code points in a row that both have share a hash
        t, e = docs[i] or "", plain[i]
        if len(t) >= 64:
            assert hashes(f[i].a) & hashes(f[i].b) and t[:23] == e[:23]


def test_op6(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in run(spark, "op6_html_extraction")} == {i: html_render.render(h) for i, h in pages.items()}


def test_op8(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op8_quality_classifier")}
    assert set(rows) == set(docs) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.kept == (r.score >= 0.5) for r in rows.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    assert np.mean([rows[i].kept == bool(y) for i, y in labels.items() if i in rows]) > 0.9
    votes = weak_labels.votes(weak_labels.measure(list(docs.values())))
    assert votes.shape == (len(docs), len(weak_labels.LABELLERS)) and set(np.unique(votes)) <= {-1, 0, 1}


def test_op9_never_reads_held_out_labels(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op9_toxicity")}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r.held_out == (binascii.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    y = spark.read.parquet(f"{SF}/labels.parquet").withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.train(d, y.filter(~held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in toxicity.scored(d.select("doc_id", "text"), model).collect()}
    assert all(abs(got[i] - r.score) < 1e-9 for i, r in rows.items())
