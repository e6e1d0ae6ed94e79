"""Every operator and pipeline stage on awkward tables: nulls, empty and very long texts, repeated rows, extra
columns with clashing names, empty tables."""

import pytest

import corpus_pipeline
from framelake.llm import (exact_dedup, html_extract, mixing, pii, quality_classifier, quality_rules, secret_scan, simhash,
                           url_filter)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, fp long, " \
       "node long, copy int, position double, block long, words string, score double, host string"
PAGES = "page_id long, url string, html string, text string, host string, rule string, verdict string"
EXTRA = (None, "x", 1, 2, 3, 0.5, 4, "w", 0.1, "h")


def docs_rows():
    long = "the quick brown fox and the lazy dog of this story " * 20_000
    texts = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n "), (5, long), (5, long), (6, "a  b\tc"), (None, "a b c"),
             (None, None), (7, "ünï \u00a0 \u3000 \U0001f600 '"), (8, "password = hunter22 AKIA" + "A" * 20), (9, "<|endoftext|>")]
    return [(i, t, None if i == 3 else "en", None if i in (2, 7) else f"src{(i or 0) % 2}", None, *EXTRA) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(docs_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {"rules": quality_rules.judge, "exact": exact_dedup.copy_groups, "mix": mixing.mix, "secrets": secret_scan.scan,
             "pii": pii.pseudonymise, "simhash": simhash.near_classes, "classifier": quality_classifier.classify}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(docs, none, name):
    rows = OPERATORS[name](docs).collect()
    assert len(rows) >= len(docs_rows()) and all(len(set(r.asDict())) == len(r) for r in rows)
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages(spark, docs, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "")
    if k < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows
    assert stage(spark, none, "").collect() == []
    if name == "exact_dedup":
        # "a b c" is in rows 1, 6 and null: 1 stays; 2, 3, null: empty, 2 stays; 4 is one space
        assert sorted(r.doc_id for r in rows) == [1, 2, 4, 5, 7, 8, 9]
    if name == "mixing":
        assert {r.doc_id for r in rows} == {r[0] for r in docs_rows()}


def test_pages(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://A.B.NET", "<p"), (4, "http://x.org/fr/", "<article><p>a"),
            (4, "http://x.org/fr/", "<article><p>a"), (None, "x://", "<!-- "), (5, "http://x.org/", "<p>" + "a " * 500_000)]
    pages = spark.createDataFrame([(*r, "t", "h", "r", "v") for r in rows], PAGES)
    none = spark.createDataFrame([], PAGES)
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[3].host, got[3].path, got[3].rule) == ("a.b.net", "", None)  # no path: it doesn't start with /
    assert (got[4].rule, got[4].verdict) == ("org/fr/", "allow")
    texts = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert texts[1] == texts[2] == texts[3] == ("", 0) and texts[4] == ("a", 1)
    assert url_filter.judge(none).collect() == [] and html_extract.extract(none).collect() == []
    assert url_filter.judge(pages).count() == html_extract.extract(pages).count() == len(rows)
