"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest

from themeloom.llm import bpe, exact, html_text, language, order_minhash, packing, secrets, simhash, surrogates, urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string, kept boolean, label int"
LONG = "lorem ipsum dolor " * 8_000 + "x" * 70_000
TEXTS = [(1, "one two three four"), (1, "one two three four"), (2, None), (3, ""), (4, LONG), (None, "of no id"),
         (None, None), (5, "one  two\tthree four"), (6, "12 34"), (7, "Ünï çödé 漢字 😀 \x00 é")]
PAGE_SCHEMA = "page_id long, url string, html string, text string, host string"
PAGES = [(1, "https://a.dev/x", "<p>Some text of a page, long enough."), (1, "https://a.dev/x", "<p>Some text of a page, long enough."),
         (2, None, None), (None, "", ""), (3, "no scheme", "<" * 5_000), (4, "http://n.net/" + "p" * 20_000, "<div>" * 3_000 + "deep")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, "mine", True, 3) for i, t in rows], SCHEMA)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "h") for r in rows], PAGE_SCHEMA)


OPERATORS = {
    "language": lambda df: language.predict(df, language.train(df)),
    "packing": lambda df: packing.pack(df, TOKENIZER),
    "order_minhash": order_minhash.compare,
    "exact": exact.groups,
    "first_of_equal": exact.first_of_equal,
    "surrogates": lambda df: surrogates.replace(df, "key"),
    "bpe": lambda df: bpe.encode(df, TOKENIZER),
    "simhash": simhash.near_copies,
    "secrets": lambda df: secrets.scan(df, secrets.train(df)),
}
ON_PAGES = {
    "urls": lambda df: urls.judge(df, urls.rule_table(df.sparkSession, urls.RULES)),
    "html_text": lambda df: html_text.extract(df, html_text.train(df)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_of_all_kinds(spark, name):
    made = OPERATORS[name](documents(spark, TEXTS)).collect()
    assert len(made) == {"first_of_equal": 6}.get(name, len(made))
    if name not in ("packing", "first_of_equal"):
        assert len(made) == len(TEXTS)
        assert sorted(str(r["doc_id"]) for r in made) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(spark, name):
    assert OPERATORS[name](documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", ON_PAGES)
def test_pages_of_all_kinds(spark, name):
    made = ON_PAGES[name](pages(spark, PAGES)).collect()
    assert sorted(str(r["page_id"]) for r in made) == sorted(str(r[0]) for r in PAGES)


@pytest.mark.parametrize("name", ON_PAGES)
def test_no_pages(spark, name):
    assert ON_PAGES[name](pages(spark, [])).collect() == []


def test_repeated_rows_keep_exactly_one(spark):
    made = exact.groups(documents(spark, TEXTS)).collect()
    same = [r for r in made if r["doc_id"] in (1, 5)]
    assert sum(r["kept"] for r in same) == 1
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(1, 3)}
    empty = [r for r in made if r["group_size"] == 3 and r["keep_id"] == 2]
    assert {r["doc_id"] for r in empty} == {2, 3, None}
    assert [r["doc_id"] for r in empty if r["kept"]] == [2]


def test_columns_of_others_are_carried(spark):
    made = surrogates.replace(documents(spark, [(1, "a@b.example.com")]), "key").first()
    assert made["_text"] == "mine" and made["kept"] is True and made["label"] == 3
    made = bpe.encode(documents(spark, [(1, "abc")]), TOKENIZER).first()
    assert made["_text"] == "mine" and made["n_tokens"] == 1
