"""The pipeline against a brute-force version, its stages one by one on small rows, and the queries against their SQL."""

import base64
import hashlib
import re

import compare
import public_tokenizers
import pytest
import rows
import tiktoken

import __spark_entry__ as entry_point
import corpus_pipeline
from fanchart.llm import decontaminate, pii, quality, queries, simhash
from test_group_operators import roots_of

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def full(texts, first=0):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, first)]


def test_stage_names_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE"]
    known = entry_point.queries()
    assert known["pipeline"] is corpus_pipeline.run
    assert [sum(name.startswith(f"op{n}_") for name in known) for n in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = compare.connect(sf_dir)
    assert compare.differences(spark, con, sf_dir, queries.queries()[name], queries.oracle_sql()[name]) == []


def test_pipeline_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    classifier = quality.fit(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = {i: t for i, t in docs.items() if classifier.score(t)[0] >= 0.5}
    prints = {i: simhash.fingerprint(t) for i, t in docs.items()}
    near = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    docs = {i: docs[i] for i, root in roots_of(docs, near).items() if i == root}
    lists = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[s : s + 10]) for w in lists if w for s in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = decontaminate.words_of(text)
        return not any(tuple(words[s : s + n]) in windows for n in sizes for s in range(len(words) - n + 1))

    docs = {i: t for i, t in docs.items() if clean(t)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got.keys() == docs.keys() and len(docs) > 50
    for i, text in docs.items():
        base, more = pii.find_spans(text or "")
        text = pii.redact(text or "", base + more)
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_near_duplicate_stage_keeps_one_of_each_group(spark, sf_dir):
    text = rows.prose(1, 300)
    data = [*full([text, text, text + " end", rows.prose(2, 300), None, ""], 5), (5, text, "en", "s", 1), (None, rows.prose(3, 300), "en", "s", 1)]
    kept = corpus_pipeline.near_duplicates(spark, rows.table(spark, data, KIND), sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "8", "9", "None"]


def test_near_duplicate_stage_with_repeated_and_missing_ids(spark, sf_dir):
    """One row of a group stays though several texts have its smallest id; groups that an id names alike both keep one."""
    text, other = rows.prose(1, 300), rows.prose(9, 300)
    data = [(1, text), (1, text + " tail"), (2, text), (None, text + " end"), (1, other), (None, rows.prose(4, 200)), (None, rows.prose(4, 200))]
    data = [(i, t, "en", "s", len(t)) for i, t in data]
    kept = corpus_pipeline.near_duplicates(spark, rows.table(spark, data, KIND), sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "None"]
    assert {r.text[:20] for r in kept} == {text[:20], other[:20], rows.prose(4, 200)[:20]}


def test_pii_stage_rewrites_the_text(spark, sf_dir):
    data = full(["write to a@b.c or +1 (017) 555-7713 now", None, "no data"])
    got = corpus_pipeline.personal_data(spark, rows.table(spark, data, KIND), sf_dir).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["write to [EMAIL] or [PHONE] now", None, "no data"]
    assert [r.n_chars for r in got] == [31, None, 7] and not re.search("@", got[0].text)


def test_stages_of_an_empty_table(spark, sf_dir):
    empty = rows.table(spark, [], KIND)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
