"""The pipeline's stages on one another's results, against brute force."""

import re

import pytest

import corpus_pipeline as cp
from tessera.llm import packing
from tests.llm.test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, apply in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        apply(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_columns_and_decisions(stages):
    columns = stages["documents"].columns
    assert all(stages[n].columns == columns for n, _ in cp.STAGES[:-1])
    texts = lambda n: {r.doc_id: r.text for r in stages[n].collect()}
    before, languages, exact, near = (texts(n) for n in ("documents", "language_id", "exact_dedup", "simhash_near_dedup"))
    assert len(languages) >= 0.98 * len(before) and languages.items() <= before.items()
    norm, low = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), {}
    for i, t in languages.items():
        low[norm(t)] = min(i, low.get(norm(t), i))
    assert set(exact) == set(low.values())
    ids = sorted(exact)
    groups = plain_groups(ids, [plain_fingerprint(exact[i]) for i in ids])
    assert set(near) == {i for i in ids if groups[i] == i}


def test_packed_rows_are_the_mixed_documents(stages):
    mixed = [r.doc_id for r in stages["mixing"].collect()]
    pieces = stages["packing"].collect()
    assert set(mixed) <= set(r.doc_id for r in stages["simhash_near_dedup"].collect())
    encode, _ = packing.make_encoder("byte_bpe_50k")
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    want = sum(len(encode(texts[i])) + 1 for i in mixed)
    assert sum(p.length for p in pieces) == want and sum(p.start == 0 for p in pieces) == len(mixed)


def test_run_equals_the_stages(spark, stages):
    key = lambda r: (r.sequence_id, r.offset)
    got = sorted(cp.run(spark, SF).collect(), key=key)
    want = sorted(stages["packing"].collect(), key=key)
    assert sum(r.length for r in got) == sum(r.length for r in want) and len({r.doc_id for r in got}) == len({r.doc_id for r in want})


def test_stages_on_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "src0", 0), (None, "some words here", "en", None, 15),
                                 (3, "die und der das", "de", "src1", 15), (3, "die und der das", "de", "src1", 15)], schema)
    for frame in (odd.limit(0), odd):
        docs = frame
        for _, apply in cp.STAGES:
            rows = apply(spark, docs, SF).collect()
            docs = spark.createDataFrame(rows, schema) if apply is not cp.packed else None


def test_documents_without_identifier_through_mixing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_rate int, copy_no int, place string"
    rows = [(None, f"text number {i} of this table", "en", f"src{i % 12}", 3, 1, 2, "p") for i in range(1500)]
    out = cp.mixed(spark, spark.createDataFrame(rows, schema), SF)
    assert out.columns == [f.split()[0] for f in schema.split(", ")]
    counts = {}
    for r in out.collect():
        counts[r.text] = counts.get(r.text, 0) + 1
        assert (r.mix_rate, r.copy_no, r.place) == (1, 2, "p")
    assert len(set(counts.values())) > 1 and 0.2 < len(counts) / 1500 < 0.95
