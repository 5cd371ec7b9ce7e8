import corpus_pipeline
from promptloom.llm import pii, toxicity
from promptloom.llm.queries import QUERIES

from . import test_bpe, test_decontaminate, test_jaccard
from .conftest import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near_duplicates(rows):
    sets = {i: test_jaccard.shingles(t, 5) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = [i for i in sets if sets[i]]
    holders = {}
    for i in ids:
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    for i in ids:
        near = {}
        for x in sets[i]:
            for j in holders[x]:
                if j > i:
                    near[j] = near.get(j, 0) + 1
        for j, both in near.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    scored = toxicity.report(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in scored.collect() if r.predicted}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS, name
        if name == "toxicity":
            kept = [r for r in kept if r[0] not in toxic]
        elif name == "near_duplicates":
            first = near_duplicates(kept)
            assert len(first) < len(kept)
            kept = [r for r in kept if r[0] in first]
        elif name == "decontamination":
            bad = {r[0] for r in test_decontaminate.expected(kept, items) if r[5]}
            assert bad
            kept = [r for r in kept if r[0] not in bad]
        else:
            kept = [(i, t and pii.redacted(t, pii.find(t))) for i, t in kept]
        found = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
        assert found == sorted(kept, key=repr), name
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    found = sorted((tuple(r[n] for n in names) for r in corpus_pipeline.run(spark, sf).collect()), key=repr)
    assert found == test_bpe.digest(kept)


def test_stages_on_odd_documents(spark, sf, nasty):
    types = "doc_id long, text string, lang string, source string, n_chars long, score double"
    for rows in ([], list(nasty)):
        docs = spark.createDataFrame([(i, t, None, None, None, 1.0) for i, t in rows], types)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert docs.count() <= len(rows), name
            assert name == "bpe" or docs.schema.simpleString() == "struct<" + types.replace("long", "bigint").replace(" ", ":").replace(",:", ",") + ">"


def test_entry_has_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert table is not None
