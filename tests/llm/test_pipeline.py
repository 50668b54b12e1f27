import random

import pytest
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lumenshelf.llm import bpe  # noqa: E402
from lumenshelf.llm.queries import vocabulary_path  # noqa: E402


def documents():
    rnd = random.Random(11)
    words = {"en": "the and with from that house garden river stone".split(), "de": "der und mit von dass haus garten fluss stein".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rnd.choices(words[lang], k=rnd.randint(30, 60))), lang, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1].replace(" ", "  "), rows[i][2], "s9") for i in range(10)]  # exact copies
    long = " ".join(f"{rnd.choice(words['en'])}{k}" for k in range(4000))
    rows += [(300, long, "en", "s1"), (301, long + " end", "en", "s1")]  # near copies
    return rows + [(400, "123 456", "en", "s1"), (401, None, "en", "s1"), (402, "", None, None)]


def test_each_stage_does_its_part(spark, make_docs, tmp_path, clashes_kept):
    docs, kept = make_docs(documents()), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns and clashes_kept(docs.collect())
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    language, exact, near, mixed = kept
    assert set(language) == {r[0] for r in documents()} - {400, 401, 402}
    assert set(exact) == set(language) - set(range(200, 210))
    assert set(near) == set(exact) - {301}
    assert set(mixed) <= set(near) and len(mixed) > 0.7 * len(near)
    texts = {r[0]: r[1] for r in documents()}
    words = bpe.vocabulary(vocabulary_path())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in last) == mixed
    assert all(r["n_tokens"] == len(words.encode(texts[r["doc_id"]])) for r in last)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_empty_and_odd_tables(spark, make_docs, odd_rows, tmp_path):
    for k, rows in enumerate(([], odd_rows)):
        folder = tmp_path / str(k)
        make_docs(rows).write.parquet(str(folder / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).count() >= (6 if rows else 0)
