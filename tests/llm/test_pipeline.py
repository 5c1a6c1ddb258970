import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from sawmill.llm import bpe, common, decontam, licenses, pii, quality

from .test_classifiers import corpus, prose
from .test_decontam import distance
from .test_ngram_join import brute as components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = corpus(3, 260)
    rng = random.Random(1)
    item = "rare benchmark question about granite rivers and paper moons over seven hills"
    clean = [i for i, (_, q, _) in enumerate(labels) if q]
    for i in clean[::4]:  # personal data in labelled documents, so that it is no sign of low quality
        docs[i] = (i, f"{docs[i][1]} reach me at a{i}@b.org or +1 (555) 010-{1000 + i} ok")
    for k in range(12):
        i = rng.choice(clean)
        text = docs[i][1]
        docs.append((1000 + k, [text, text + " tail", f"{prose(rng, 60)} {item} end", f"{prose(rng, 60)} reach me at a{k}@b.org or +1 (555) 010-12{k:02d} ok"][k % 4]))
    rows = [(i, t, "en", "s", len(t), 1) for i, t in docs] + [(2000, None, None, None, None, 1), (2001, "", "en", "s", 0, 1), (None, "no id " + docs[1][1], "en", "s", 5, 1)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, [(r[0], r[1]) for r in rows], item


def test_stages_like_a_plain_version(spark, tables):
    d, docs, item = tables
    seen, model = docs, quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    frame = spark.read.parquet(f"{d}/documents.parquet")
    score = {(r.doc_id, r.text): r.score for r in quality.with_scores(frame.drop("score"), model).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.written(stage(spark, frame, d), name)
        assert frame.columns == corpus_pipeline.COLUMNS
        key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
        got = sorted([(r.doc_id, r.text) for r in frame.collect()], key=key)
        if name == "quality_classifier":
            want = [x for x in seen if score[x] >= 0.7]
            assert len(want) < len(seen)
        elif name == "ngram_jaccard_join":
            first = {(i, c) for i, _, c in components(seen)}
            want = [x for x in seen if x[0] is None or (x[0], x[0]) in first]
            assert len(want) < len(seen)
        elif name == "benchmark_decontamination":
            p = decontam.normalise(item)
            want = [x for x in seen if x[1] is None or x[0] is None or distance(p, decontam.normalise(x[1])) > int(len(p) * decontam.ERROR_RATE)]
            assert len(want) < len(seen)
        else:
            want = got
            assert [i for i, _ in got] == [i for i, _ in sorted(seen, key=key)]
            changed = [i for (i, t), (j, u) in zip(sorted(seen, key=key), got) if t != u]
            assert changed and all("<EMAIL>" in t for i, t in got if i in changed)
            assert not any(pii.digest(pii.find(frame)).select("n_email", "n_ip", "n_card", "n_phone").where("n_email + n_ip + n_card + n_phone > 0").collect())
        assert got == sorted(want, key=key)
        seen = got
    ranks, pattern = bpe.default_vocabulary()
    last = corpus_pipeline.STAGES[-1][1](spark, frame, d).collect()
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = sorted((-1 if i is None else i, len(enc.encode_ordinary(t or ""))) for i, t in seen)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in last) == want
    whole = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str)
    assert whole == sorted(map(tuple, last), key=str)
    assert np.all([len(r.ids_sha256) == 64 for r in last])


def test_settings_of_the_session_stay(spark, nasty):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    out = licenses.scan_licenses(nasty)
    assert out.count() == nasty.count() and spark.conf.get(key) == before
    assert out.sparkSession.conf.get(key) == str(common.BATCH_ROWS)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://somewhere:7077", "applicationId": "a"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Elsewhere)


def test_small_frames_hold_all_rows():
    pdf = pd.DataFrame({"text": ["ab" * i for i in range(50)] + [None], "n": range(51)})
    got = list(common.small_frames([pdf, pdf.iloc[:0]], chars=300))
    assert pd.concat(got).reset_index(drop=True).equals(pdf) and len(got) > 5
    assert all(x["text"].str.len().iloc[:-1].sum() <= 300 for x in got)
