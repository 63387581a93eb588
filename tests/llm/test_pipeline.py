"""Every stage of the pipeline on its own input against brute force, and the pipeline as a whole."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import WORD_BPE, brute_components, brute_fingerprint, brute_lines, brute_substrings, check_sequences, rows

import corpus_pipeline
from quillsift.llm.language import has_letter
from quillsift.llm.queries import MIN_SITES, WINDOW


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    data = [(*x, len(x[1] or "")) for x in rows() if x[0] not in (3, 5) and len(x[1] or "") < 9000]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def taken(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = taken(docs), docs.columns
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != names[-1]:
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
            out[name] = before, taken(docs)

    before, after = out["language_id"]
    assert set(after) <= set(before)
    gone = set(before) - set(after)
    assert {x for x in before if not has_letter((x[1] or "").encode())} <= gone and len(gone) < 8

    before, after = out["line_dedup"]
    kept = {before[i][0]: t for i, t in brute_lines(before, MIN_SITES).items()}
    texts = {x[0]: x[1] for x in before}
    assert {x[0]: x[1] for x in after} == {d: t for d, t in kept.items() if t == texts[d] or t.strip(" \n")}

    before, after = out["simhash_near_dedup"]
    ids = [x[0] for x in before]
    component = brute_components([brute_fingerprint(x[1]) for x in before], ids)
    assert Counter(after) == Counter(x for x, c in zip(before, component, strict=True) if x[0] is None or x[0] == c)
    assert len(after) < len(before)

    before, after = out["substring_dedup"]
    want = {d: (n, removed) for d, n, removed, _ in brute_substrings(before, WINDOW)}
    texts = {x[0]: x[1] for x in after}
    assert set(texts) == {d for d, (n, removed) in want.items() if n > removed or not n}
    assert all(len((t or "").encode().split()) == want[d][0] - want[d][1] for d, t in texts.items())
    assert any(removed for _, removed in want.values())

    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(WORD_BPE), docs.collect()
    tokens = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in after}
    assert {r["doc_id"]: r["ids_crc32"] for r in pieces} == {d: zlib.crc32(np.asarray(ids, "<u4").tobytes()) for d, ids in tokens.items()}
    assert check_sequences(pieces, 4096) == -(-sum(map(len, tokens.values())) // 4096)


def test_run(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(own).collect())) == Counter(map(tuple, docs.select(own).collect()))
    assert whole.count() > 50


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
