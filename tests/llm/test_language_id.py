import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.llm import language_id

SENTENCES = {
    "en": "the house and the garden are in the town where they were with that man",
    "de": "das haus und der garten sind in der stadt und nicht auf dem berg gewesen",
    "fr": "la maison et le jardin sont dans la ville avec les hommes qui ont une voiture",
}


def corpus(n=60):
    rows = []
    for k, (lang, text) in enumerate(SENTENCES.items()):
        words = text.split()
        for i in range(n):
            rows.append((k * n + i, " ".join(words[(i * j) % len(words)] for j in range(1, 20)), lang, f"host{i % 3}"))
    return rows


def test_trigrams():
    assert len(language_id.trigrams(None)) == len(language_id.trigrams("12 !?")) == 0
    assert len(language_id.trigrams("ab")) == 2
    assert (language_id.trigrams("Ab,c") == language_id.trigrams(" ab -- C ")).all()
    assert language_id.trigrams("漢字 ß é").max() < 1 << language_id.BUCKET_BITS


def test_text_wins_over_a_wrong_declaration(make_docs):
    rows = corpus()
    rows += [(900, SENTENCES["de"] * 3, "en", "host0"), (901, SENTENCES["fr"], None, None), (902, "12345 %%% 67", "en", "host1"), (903, None, "de", "host1"), (904, "", None, None)]
    got = {r["doc_id"]: r for r in language_id.identify_documents(make_docs(rows)).collect()}
    assert all(got[i]["language"] == lang and got[i]["kept"] for i, _, lang, _ in rows[:180])
    assert got[900]["language"] == "de" and got[901]["language"] == "fr"
    assert not any(got[i]["kept"] for i in (902, 903, 904)) and got[903]["language"] == "und"
    kept = language_id.keep_identified(make_docs(rows))
    assert {r["doc_id"] for r in kept.collect()} == set(range(180)) | {900, 901}
    assert kept.columns == make_docs(rows).columns


def test_posterior_is_the_product_of_its_evidence(make_docs, spark, monkeypatch):
    """The fused posterior, recomputed from the same counts with numpy."""
    rows = corpus(20) + [(990, "ga", "de", "host1")]
    docs = make_docs(rows)
    base = docs.selectExpr("doc_id AS _id", "lang AS _declared", "source AS _host", "CAST(NULL AS STRING) AS _domain", "CAST(NULL AS STRING) AS _suffix", "text AS _text")
    model = language_id.fit_text_model(base)
    evidence = {i: model.evidence(t)[0] for i, t, _, _ in rows}
    best = {i: int(np.argmax(e)) for i, e in evidence.items()}
    n, s = len(model.languages), language_id.SMOOTHING
    overall = np.bincount(list(best.values()), minlength=n).astype(float)
    prior = np.append((overall[:-1] + 1) / (overall[:-1] + 1).sum() * (1 - language_id.UNKNOWN_PRIOR), language_id.UNKNOWN_PRIOR)
    got = {r["doc_id"]: r for r in language_id.identify_documents(docs).collect()}
    for i, _, lang, host in rows[::7] + [rows[-1]]:
        on_host = [best[j] for j, _, _, h in rows if h == host]
        host_prior = (np.bincount(on_host, minlength=n) + s * prior) / (len(on_host) + s)
        with_lang = [best[j] for j, _, d, _ in rows if d == lang]
        rate = len(with_lang) / len(rows)
        declared = np.log((np.bincount(with_lang, minlength=n) + s * rate) / (overall + s))
        declared[-1] = np.log(rate)
        logs = evidence[i] + np.log(np.maximum(host_prior, 1e-12)) + declared
        posterior = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[i]["language"] == model.languages[int(np.argmax(posterior))]
        assert got[i]["confidence"] == pytest.approx(posterior.max(), abs=1e-6)


def test_odd_rows_and_empty_table(make_docs, odd_rows):
    got = language_id.identify_documents(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert language_id.identify_documents(make_docs([])).collect() == []
    assert language_id.keep_identified(make_docs([])).collect() == []


def test_without_any_declared_language(make_docs):
    got = {r["doc_id"]: r["kept"] for r in language_id.identify_documents(make_docs([(1, "some words", None, "a"), (2, "123", None, "a")])).collect()}
    assert got == {1: True, 2: False}


RARE = "zażółć gęślą jaźń pchnąć w tę łódź jeża lub ośm skrzyń fig"


def base_rows(docs):
    return docs.selectExpr("doc_id AS _id", "lang AS _declared", "text AS _text")


def test_rare_language_is_learned_whatever_the_sample(make_docs):
    """With a sample of a few rows of the others, all rows of a rare tag are still read."""
    rows = corpus(60) + [(800 + k, RARE, "pl", "host0") for k in range(3)] + [(810, RARE, None, "host1")]
    counts = {n: language_id.fit_text_model(base_rows(make_docs(rows)), n).table[:, 2] for n in (1, 20_000)}
    assert (counts[1] == counts[20_000]).all()
    got = {r["doc_id"]: r["language"] for r in language_id.identify_documents(make_docs(rows), train_rows=1).collect()}
    assert got[810] == "pl"


def test_sample_is_bounded_for_each_language(make_docs, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGE_ROWS", 20)
    rows = corpus(300) + [(None, RARE + f" {k}x", "pl", "host0") for k in range(15)]
    few, all_rows = (language_id.fit_text_model(base_rows(make_docs(rows)), n) for n in (1, 20_000))
    assert few.languages == all_rows.languages == ["de", "en", "fr", "pl", "und"]
    differs = (few.table != all_rows.table).any(axis=0)
    assert differs.tolist() == [True, True, True, False, False]


def test_tag_without_letters_names_nothing(make_docs):
    """Neither a tag without any trigram nor a tie takes the place of ``und``."""
    rows = corpus(20) + [(700, "12 34", "aa", "host0"), (701, "ჟღფ ჭძწ ხჯჰ ჟჭხ ღძჯ ფწჰ " * 60, None, None)]
    model = language_id.fit_text_model(base_rows(make_docs(rows)))
    assert model.languages == ["de", "en", "fr", "und"]
    got = {r["doc_id"]: r for r in language_id.identify_documents(make_docs(rows)).collect()}
    assert got[701]["language"] == got[701]["text_language"] == "und" and not got[701]["kept"]


def test_ties_go_to_the_unknown_language(spark):
    model = language_id.TextModel(["aa"], np.zeros((1, 1 << language_id.BUCKET_BITS)))
    rows = spark.createDataFrame([(1, None, None, None, None, "some words")], "_id long, _declared string, _host string, _domain string, _suffix string, _text string")
    assert language_id.score_texts(rows, model).first()["best"] == 1


def test_held_out_accuracy(spark, sf_dir):
    """A third of the documents is not learned from: it comes without a declared language and from an unknown
    source, so the text alone must tell what was declared."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0) & F.col("lang").isNotNull()
    want = {r["doc_id"]: r["lang"] for r in docs.where(held).collect()}
    blind = docs.withColumns({"source": F.when(held, "elsewhere").otherwise(F.col("source")), "lang": F.when(~held, F.col("lang"))})
    got = {r["doc_id"]: r["language"] for r in language_id.identify_documents(blind).collect()}
    assert len(want) > 40 and np.mean([got[i] == lang for i, lang in want.items()]) > 0.95


def test_more_languages_than_the_table_holds(make_docs, monkeypatch):
    """The least declared one has no column; its texts are named by the others, and nothing breaks."""
    rows = corpus(30) + [(500 + k, SENTENCES["en"], "xx", "host9") for k in range(3)]
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    out = language_id.identify_documents(make_docs(rows)).collect()
    assert len(out) == len(rows) and {r["language"] for r in out} <= {"en", "de", "fr", "und"}


def test_pages_use_host_and_suffix(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = language_id.identify_pages(pages).collect()
    assert len(rows) == pages.count()
    assert np.mean([r["language"] == r["declared"] for r in rows if r["n_grams"]]) > 0.95
    odd = spark.createDataFrame([(None, None, None), (1, "no address", "<html lang=de-AT><p>x"), (1, "http://a.b.example.com/de/x", "<p>haus und garten</p>")], "page_id long, url string, html string")
    assert len(language_id.identify_pages(odd).collect()) == 3
    assert language_id.identify_pages(odd.where("page_id = 7")).collect() == []
