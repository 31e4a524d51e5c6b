"""URL rules and surrogates, and that their plans hold no Python."""

import re

from pyspark.sql import functions as F

from themeloom.llm import exact, surrogates, urls
from themeloom.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, urls.rule_table(spark, urls.RULES), redirects).collect()}


def test_redirects_carry_decisions(spark):
    link = '<link rel="canonical" href="{}">'
    made = judged(spark, [
        (1, "https://a.dev/x", link.format("https://b.example.net/q")), (2, "https://c.dev/y#f", '<meta http-equiv="refresh" content="0; url=https://a.dev/x">'),
        (3, "https://z.example.net/en/1", link.format("https://free.dev/1")), (4, "https://free.dev/1", ""), (5, "https://q.net/1", link.format("https://free.dev/1")),
        (6, None, None), (7, "no scheme", ""), (8, "https://h.dev/d/p?x=1", link.format("../r")), (9, "https://r.dev/", "")],
        spark.createDataFrame([("https://r.dev/", "https://k.net/")], "a string, b string"))
    assert made == {1: (None, "block"), 2: (None, "block"), 3: ("example.net/en/", "allow"), 4: (None, "allow"), 5: ("net/", "block"),
                    6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "block")}


def test_rules_against_plain_code(spark):
    made = QUERIES["op2_url_filter"](spark, TINY).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{TINY}/pages.parquet").collect()}
    assert len(made) == len(pages)
    for row in made:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[row["page_id"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_chain_of_redirects(spark):
    edges = [(f"https://s{i}.dev/", f"https://s{i + 1}.dev/") for i in range(40)] + [("https://s40.dev/", "https://x.net/")]
    made = judged(spark, [(i, f"https://s{i}.dev/", "") for i in range(41)], spark.createDataFrame(edges, "a string, b string"))
    assert set(made.values()) == {(None, "block")}


def replaced(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in surrogates.replace(rows, key).orderBy("doc_id").collect()]


def test_kinds_formats_and_coreference(spark):
    a, b, c, d = replaced(spark, [
        "Mail bob.smith+x@mail7.example.com, again bob.smith+x@mail7.example.com; call +1 (017) 555-7713",
        "Herr Max Müller und Frau Müller, Mr. Smith, card 4539 1488 0343 6467 at 10.0.0.1",
        "иван.петров@почта.example.com", "bob.smith+x@mail7.example.com and nothing else"])
    mail = re.findall(r"\S+@[\w.]+\w", a)
    assert mail[0] == mail[1] == d.split()[0] and "bob" not in a and re.fullmatch(r"[a-z]{3}\.[a-z]{5}\+[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", mail[0])
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}$", a) and "555-7713" not in a
    male = surrogates.GIVEN["m"].split()
    m = re.match(r"Herr (\w+) (\w+) und Frau (\w+), Mr\. (\w+), card (\d{4} \d{4} \d{4} \d{4}) at (\d+\.\d+\.\d+\.\d+)$", b)
    assert m and m[1] in male and m[2] == m[3] != m[4]
    digits = [int(x) for x in m[5].replace(" ", "")]
    assert sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"[а-я]{4}\.[а-я]{6}@[а-я]{5}\.[a-z]{7}\.com", c) and "иван" not in c
    assert replaced(spark, ["a@b.example.com"], "k") != replaced(spark, ["a@b.example.com"], "other")


def test_collisions_are_resolved(spark):
    texts = [f"Mr Aa{chr(97 + i // 26)}{chr(97 + i % 26)} Smith" for i in range(120)]  # more than there are given names
    made = replaced(spark, texts)
    assert len(set(made)) == len(texts) and not set(made) & set(texts)
    pairs = [f"{x}@y{z}.example.com" for x in "abcdefghij" for z in range(10)]  # one letter and one digit: hardly any room
    out = replaced(spark, [" ".join(pairs)])[0].split()
    assert len(set(out)) == len(pairs) and not set(out) & set(pairs)


def test_no_python_in_plans(spark):
    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    documents = spark.read.parquet(f"{TINY}/documents.parquet")
    for made in (urls.judge(pages, urls.rule_table(spark, urls.RULES)), exact.groups(documents), surrogates.replace(documents, "k")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)


def test_surrogates_end_where_nothing_can_be_exchanged(spark, monkeypatch):
    """Addresses without a letter or digit before the sign, whose domains have few surrogates: all get one of their own."""
    monkeypatch.setattr(surrogates, "WIDEN", 1)
    texts = [f"_@{c}.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    made = replaced(spark, texts, "key")
    assert len(set(made)) == 26 and not set(made) & set(texts)
    assert all(m.endswith(".com") and m.startswith("_") for m in made)


def test_every_form_can_be_widened(spark):
    """From ``WIDEN`` tries on, surrogates of one entity differ from try to try and keep its kind's look."""
    kinds = {"email": "_@a.com", "ip": "10.0.0.1", "iban": "DE00 1234 5678 9012", "phone": "+49 30 1234567", "ssn": "123-45-6789",
             "card": "4111 1111 1111 1111", "name": "Dr Иванов"}
    tries = spark.createDataFrame([(k, v, t) for k, v in kinds.items() for t in range(surrogates.WIDEN + 8)], "kind string, value string, t int")
    made = tries.select("kind", "value", "t", surrogates.surrogate(F.col("kind"), F.col("value"), F.col("t"), "key").alias("made")).collect()
    for kind, value in kinds.items():
        late = [r["made"] for r in made if r["kind"] == kind and r["t"] >= surrogates.WIDEN]
        assert len(set(late)) == 8 and value not in late
    assert all(re.fullmatch(r"Dr [а-яА-ЯёЁ]+", r["made"]) for r in made if r["kind"] == "name")


def test_one_entity_in_many_spellings(spark):
    """Case, spacing, title and format of a mention are its own; its entity decides what it is replaced by."""
    a, b, c, d, e = replaced(spark, [
        "Mr John Smith met Mr. John Smith and Dr John Smith. Later SMITH, no, Smith and John left; Smithers stayed.",
        "Ask Bob.Lee@X1.example.com, bob.lee@x1.example.com or BOB.LEE@X1.EXAMPLE.COM.",
        "4539 1488 0343 6467 is 4539148803436467; DE89 3704 0044 0532 0130 00 is DE89370400440532013000.",
        "+49 30 1234567, +49301234567 and +49-30-1234567; 555-123-4567 or 555.123.4567; 020 7946 0958, 030/1234567.",
        "2001:db8:0:0:0:0:0:42 is 2001:0DB8::42, 10:20:30 is a time and a::b a name."])
    m = re.match(r"Mr (\w+) (\w+) met Mr\. (\w+) (\w+) and Dr (\w+) (\w+)\. Later SMITH, no, (\w+) and (\w+) left; Smithers stayed\.$", a)
    assert m and m[1] == m[3] == m[5] == m[8] != "John" and m[2] == m[4] == m[6] == m[7] != "Smith"
    mails = re.match(r"Ask (\S+), (\S+) or (\S+)\.$", b).groups()
    assert mails[0].lower() == mails[1] == mails[2].lower() and mails[2].isupper() and mails[0][0].isupper() and "bob" not in mails[1]
    m = re.match(r"(\d{4} \d{4} \d{4} \d{4}) is (\d{16}); (DE.*) is (DE\w{20})\.$", c)
    assert m and m[1].replace(" ", "") == m[2] != "4539148803436467" and m[3].replace(" ", "") == m[4] and len(m[3]) == 27
    m = re.match(r"(\+49 \d\d \d{7}), (\+49\d{9}) and (\+49-\d\d-\d{7}); (\d{3}-\d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4}); (\d{3} \d{4} \d{4}), (\d{3}/\d{7})\.$", d)
    assert m and len({re.sub(r"\D", "", m[i]) for i in (1, 2, 3)}) == 1 and m[4].replace("-", "") == m[5].replace(".", "")
    assert not any(x in d for x in ("1234567", "4567", "0958"))
    m = re.match(r"(\w{4}:\w{1,4}:0:0:0:0:0:\w{4}) is (\w{4}:\w{4}::\w{4}), 10:20:30 is a time and a::b a name\.$", e)
    assert m and m[1].split(":")[0] == m[2].split(":")[0].lower() and m[1].split(":")[-1] == m[2].split(":")[-1].lower() and "2001" not in e


def test_names_without_title_are_replaced_where_introduced(spark):
    a, b = replaced(spark, ["Anna said that Frau Anna Lang was late. Lang left.", "Anna Lang is not introduced here."])
    m = re.match(r"(\w+) said that Frau (\w+) (\w+) was late\. (\w+) left\.$", a)
    assert m and m[1] == m[2] != "Anna" and m[3] == m[4] != "Lang" and b == "Anna Lang is not introduced here."


def test_surrogates_against_plain_code(spark):
    """Over a whole table: texts between mentions stay, and mentions and surrogates are one to one, as plain code finds them."""
    import regex
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    made = QUERIES["op7_surrogates"](spark, TINY).collect()
    assert sorted(r["doc_id"] for r in made) == sorted(texts)
    pattern, forth, back = regex.compile(surrogates._ANY.replace(r"\z", r"\Z"), regex.V0), {}, {}
    for row in made:
        spans = [m.span() for m in pattern.finditer(texts[row["doc_id"]])]
        titled = any(regex.match(surrogates._TITLED, texts[row["doc_id"]][a:b]) for a, b in spans)
        if titled:
            continue
        assert row["n_entities"] == len(spans) == sum(row[f"n_{k}"] for k in surrogates.KINDS)
        between = [texts[row["doc_id"]][a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), None])]
        found = regex.fullmatch("(?s)" + "(.+?)".join(map(regex.escape, between)), row["text"])
        assert found
        for (s, e), new in zip(spans, found.groups()):
            old = texts[row["doc_id"]][s:e].lower()
            assert forth.setdefault(old, new.lower()) == new.lower() and back.setdefault(new.lower(), old) == old and old != new.lower()
