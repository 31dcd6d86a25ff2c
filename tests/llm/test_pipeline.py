"""Each stage of the pipeline against a plain version on its own input, and the queries as registered."""

from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from tracewright.llm import pii, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from tracewright.llm.common import Scratch

    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(scratch.keep(f(spark, out[-1], DATA)))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_stage_against_labels(spark):
    """On a table with some hundred toxic labels; the labels themselves are the truth."""
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r[0] for r in corpus_pipeline.drop_toxic(spark, docs, data).select("doc_id").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean, toxic = ([d for d, t in truth.items() if t == k] for k in (0, 1))
    assert sum(d in kept for d in clean) >= 0.99 * len(clean)
    assert sum(d not in kept for d in toxic) >= 0.9 * len(toxic)


def test_stages_keep_few_files(spark, monkeypatch):
    """Own tables of the first two stages, on documents in many parts."""
    from tracewright.llm.common import Scratch

    kept, keep = [], Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        kept.append(len(list(Path(out._scratch_path.removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(30)
    for f in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies):
        kept.clear()
        assert f(spark, docs, DATA).count() > 0
        assert kept and max(kept) <= spark.sparkContext.defaultParallelism


def test_near_copies_stage(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in stages[2].collect()} == {d for d in ids if find(d) == d}


def test_leak_stage(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in stages[3].collect()}
    for r in stages[2].collect():
        if any(t in r["text"] for t in items):
            assert r["doc_id"] not in kept
    assert len(kept) >= 0.8 * stages[2].count()


def test_personal_data_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert before.keys() == after.keys()
    assert all(after[d] == pii.mask_text(t) and not pii.find_base(after[d]) for d, t in before.items())


def test_packing_stage(stages):
    got = stages[5].collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in stages[4].collect()}
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


# Columns that each query's contract names.
CONTRACTS = {
    1: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 2: "doc_id n_shingles component_id", 3: "page_id payload_bytes payload_digest record_type refers_to", 4: "doc_id held_out score predicted",
    5: "vec_id n_links component_id kept", 6: "doc_id", 7: "doc_id", 8: "doc_id n_bytes n_tokens over_limit", 9: "doc_id size text_crc32 law shard slot grown_shard", 10: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_its_contract(spark, name):
    """The columns, and a row for each input row where the contract says so."""
    k = int(name[2 : name.index("_")])
    got = queries.QUERIES[name](spark, DATA)
    assert set(CONTRACTS[k].split()) <= set(got.columns)
    table = {3: "pages", 5: "embeddings"}.get(k, "documents")
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if k in (6, 7):
        assert got.count() > 0
    else:
        key = CONTRACTS[k].split()[0]
        assert got.select(key).distinct().count() == n and (k == 10 or got.count() == n)
