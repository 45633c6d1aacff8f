import hashlib
import re

import corpus_pipeline
from tests.llm.test_pii import base
from veilframe.llm import quality
from veilframe.llm.shared import table, written

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, DATA, "documents")
    columns, steps = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        steps.append(written(stage(spark, steps[-1], DATA), name))
        assert k == len(corpus_pipeline.STAGES) - 1 or steps[-1].columns == columns
    start, good, alone, clean, mixed, tokens = ([r.asDict() for r in s.collect()] for s in steps)

    model = quality.train(docs, table(spark, DATA, "labels"))
    want = {r["doc_id"] for r in start if model.score(quality.shape(r["text"])[None].astype("float32"))[0] >= quality.ACCEPT}
    assert {r["doc_id"] for r in good} == want and 0 < len(good) < len(start)
    ids = {r["doc_id"] for r in alone}
    texts = [r["text"] for r in alone]
    assert ids <= want and len(set(texts)) == len(texts)
    assert {hashlib.md5(r["text"].encode()).digest() for r in good if r["doc_id"] in ids} == {hashlib.md5(t.encode()).digest() for t in texts}
    before = {r["doc_id"]: r["text"] for r in alone}
    for r in clean:
        assert r["n_chars"] == len(r["text"])
        if not base(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        assert not base(r["text"])
    assert {r["doc_id"] for r in clean} == ids
    after = {r["doc_id"]: r["text"] for r in clean}
    assert all(after[r["doc_id"]] == r["text"] for r in mixed)
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.1 * words(clean)
    assert sorted(r["doc_id"] for r in tokens) == sorted(r["doc_id"] for r in mixed)
    assert all(r["decoded_sha256"] == hashlib.sha256(after[r["doc_id"]].encode()).hexdigest() for r in tokens)


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, DATA, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
