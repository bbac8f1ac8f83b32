import os
import random

import corpus_pipeline
from stockweave.llm import pii, sentencepiece_lattice
from stockweave.llm.common import shared_root


def test_stages_against_plain_ones(spark, tmp_path):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    docs = []
    for i in range(240):
        words = [word() for _ in range(60)]
        if i % 6 == 0:
            words[5] = "idiot"
        docs.append(" ".join(words) + (" mail x.y@z.org" if i % 5 == 0 else ""))
    docs += [docs[1], docs[2] + " tail", None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0 and i < 240)) for i in range(len(docs))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    clean = corpus_pipeline.drop_toxic(spark, frame, str(tmp_path))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i in range(len(docs)) if i % 6 or i >= 240}
    single = corpus_pipeline.drop_near_copies(spark, clean, str(tmp_path))
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in clean.collect()} - {240, 241}
    hidden = corpus_pipeline.redact_personal_data(spark, single, str(tmp_path))
    texts = {r.doc_id: r.text for r in hidden.collect()}
    assert all(t == pii.redact(docs[i], pii.find_spans(docs[i], pii.trained())[1]) for i, t in texts.items() if docs[i] is not None)
    assert not any("@" in (t or "") for t in texts.values()) and hidden.columns == columns
    mixed = corpus_pipeline.mix_sources(spark, hidden, str(tmp_path))
    assert mixed.columns == columns and mixed.count() > 0
    path = sentencepiece_lattice.default_model()
    own = sentencepiece_lattice.Lattice(path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == mixed.count() and all(r.n_ids == len(r.ids) for r in out)
    for r in out[:40]:
        assert own.decode(r.ids) == (texts[r.doc_id] or "")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_by_five_words_from_four_fifths_on(spark, tmp_path):
    own = [f"w{i}" for i in range(200)]
    pairs, want = [], []
    for k, change in enumerate([
        lambda w: [f"new{i}" if i in (20, 60, 100, 140) else x for i, x in enumerate(w)],  # 176 of 216 shingles: 0.815
        lambda w: [f"new{i}" if i in (20, 60, 100, 140, 180) else x for i, x in enumerate(w)],  # 171 of 221: 0.774
        lambda w: w[:90] + [f"new{i}" for i in range(16)] + w[106:],  # 176 of 216: 0.815
        lambda w: w[:90] + [f"new{i}" for i in range(18)] + w[108:],  # 174 of 218: 0.798
        lambda w: w + [f"new{i}" for i in range(44)],  # 196 of 240: 0.817
        lambda w: w + [f"new{i}" for i in range(49)],  # 196 of 245: 0.8
        lambda w: w + [f"new{i}" for i in range(50)],  # 196 of 246: 0.797
    ]):
        first = [f"{k}{w}" for w in own]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (first, change(first)))
        pairs += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(change(first)))]
        want += [2 * k] + [2 * k + 1] * (100 * len(a & b) < 80 * len(a | b))
    assert len(want) == 10
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == want


def test_outputs_of_stages_go_when_the_next_is_written(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"keep{k}", lambda spark, docs, sf_dir: docs) for k in range(3)])
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in rows.collect()) == [1, 2] and spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 2
    assert [n.rsplit("-", 1)[0] for n in os.listdir(shared_root(spark)) if n.startswith("pipeline-keep")] == ["pipeline-keep2"]


def test_what_mixing_has_staged_goes_too(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"a b {k}", "s") for k in range(9)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", corpus_pipeline.mix_sources)])
    before = set(os.listdir(shared_root(spark)))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(shared_root(spark))) - before}
    assert "pipeline-mixing" in left and "mix-rows" not in left
