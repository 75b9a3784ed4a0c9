"""The pipeline on a small corpus, each stage against what it should have done with its input."""

import re
import zlib

import corpus_pipeline
import pytest
from helpers import DOC, components, docs, words

from millrace.llm import packing, queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    good = [" ".join(words(120, i, 3000)) for i in range(40)]
    near = [good[0] + " one more", good[0], good[1].replace(" ", "\n", 3)]
    secret = [" ".join(words(120, 500 + i, 3000)) + " token = abcdef0123456789abcdef0123456789" for i in range(3)]
    bad = [" ".join(w + "###" for w in words(120, 900 + i, 3000)) for i in range(40)]
    texts = good + near + secret + bad + [None, "", "short text", "x y z " * 60]
    docs(spark, texts, [f"s{i % 3}" for i in range(len(texts))]).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1 if i < 46 else 0, 0) for i in range(86)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    out, df = [texts], spark.read.parquet(str(d / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, df, str(d))
        if i < 4:
            assert made.columns == [c.split()[0] for c in DOC.split(", ")]
        made.write.parquet(str(d / f"stage{i}"))
        df = spark.read.parquet(str(d / f"stage{i}"))
        out.append(df.collect())
    return out, str(d)


def test_quality_keeps_clean_documents(stages):
    assert sorted(r.doc_id for r in stages[0][1]) == list(range(46))


def test_one_of_each_group_stays(stages):
    before, after = sorted(stages[0][1], key=lambda r: r.doc_id), {r.doc_id for r in stages[0][2]}
    want = {before[c].doc_id for _, c in components([r.text for r in before], 5, 80)}
    assert after == want and 40 not in after and 0 in after


def test_secrets_are_gone_and_nothing_else(stages):
    before = {r.doc_id: r.text for r in stages[0][2]}
    for r in stages[0][3]:
        assert r.text == re.sub(r"token = [0-9a-f]+", "[SECRET]", before[r.doc_id]) and r.n_chars == len(r.text)


def test_mix_and_pack(stages):
    rows, mixed = stages[0][3], [r.doc_id for r in stages[0][4]]
    total = sum(len(r.text.split()) for r in rows)
    size = {r.doc_id: len(r.text.split()) for r in rows}
    assert max(mixed.count(i) for i in size) <= 2 and abs(sum(size[i] for i in mixed) / total - 1.5) < 0.1
    pieces = stages[0][5]
    text = {r.doc_id: r.text for r in rows}
    assert sum(p.length for p in pieces) == sum(len(packing.encode(text[i])) for i in mixed)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(packing.encode(text[p.doc_id])[p.start : p.start + p.length].astype("<u4").tobytes())


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, stages[1])
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in got.collect()) == sum(r.length for r in stages[0][5]) and set(map(key, got.collect()))


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.QUERIES) <= set(names)
