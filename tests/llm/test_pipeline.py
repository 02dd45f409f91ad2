"""The pipeline against its stages' decisions, made one by one."""

import corpus_pipeline

from kinloom.llm import bpe, decontaminate, dedup, pii, quality
from kinloom.llm.registry import tokenizer_path
from kinloom.llm.store import table

from ..conftest import DATA
from .test_operators import pii_twin


def test_pipeline(spark):
    docs, labels, bench = (table(spark, DATA, n) for n in ("documents", "labels", "benchmark"))
    left = docs
    left = left.join(quality.classify(left, labels).where("keep").select("doc_id"), "doc_id", "left_semi")
    named = {r.doc_id: r.class_id for r in dedup.classes(left).collect()}
    firsts = {min(i for i, c in named.items() if c == k) for k in set(named.values())}
    leaked = {r.doc_id for r in decontaminate.leaks(left, bench).collect()}
    want = firsts - leaked
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    ours = bpe.loaded(tokenizer_path("word_bpe_49k.json"))
    raw = {r.doc_id: r for r in docs.collect()}
    for r in got:
        assert list(r.ids) == ours.encode(r.text) and r.n_tokens == len(r.ids) and r.decoded == ours.decode(list(r.ids))
        assert not [s for s in pii_twin(r.text) if s.startswith("email")]
        assert r.lang == raw[r.doc_id].lang and r.n_chars == len(r.text)
    assert pii.sanitise(docs).columns == docs.columns


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).dtypes == docs.dtypes
