"""Language identification, toxicity and HTML extraction."""

import html as H
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from documents_fixture import docs_of  # noqa: F401
from ledgerlake.llm import html_extract, language_id, toxicity
from ledgerlake.llm.common import read_table
from ledgerlake.llm.html_extract import main_text

SF = "/root/testdata/sf0.01"


def auc(pairs):
    ranked = sorted(pairs)
    pos = sum(y for _, y in pairs)
    ranks = sum(i + 1 for i, (_, y) in enumerate(ranked) if y)
    return (ranks - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))


def test_toxicity_on_held_out_labels(spark):
    got = {r.doc_id: r for r in E.queries()["op4_toxicity"](spark, SF).collect()}
    assert len(got) == read_table(spark, SF, "documents").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(got[x.doc_id], x.toxic) for x in read_table(spark, SF, "labels").collect() if got[x.doc_id].held_out]
    assert auc([(r.score, y) for r, y in held]) > 0.85
    chosen = [y for r, y in held if r.predicted]
    assert sum(chosen) >= 0.9 * len(chosen) and sum(chosen) >= 0.6 * sum(y for _, y in held)


def test_labels_of_the_other_rows_are_not_used(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    from ledgerlake.llm.queries import held_out

    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels.filter(~held_out())) == toxicity.fit(docs, flipped.filter(~held_out()))


MODEL = toxicity.Model({"idiot": 6.0, "scum": 5.0}, -2.0, 0.01)


def test_grammar_weighs_clauses():
    plain = MODEL.clause("the idiot came".split())
    assert MODEL.clause("you are the idiot".split()) > plain > MODEL.clause("he wrote idiot".split())
    assert MODEL.clause("the man is not an idiot".split()) < plain
    assert MODEL.clause("they kill time".split()) == toxicity.THREAT and MODEL.clause("kill time".split()) == 0
    assert MODEL.clause("no harm here".split()) == 0
    assert MODEL.score("Idiots!!! you scum.") > 0.9 > MODEL.score("word " * 200 + "idiot") and MODEL.score(None) == MODEL.score("")


def test_toxicity_of_awkward_tables(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "x " * 50_000), (None, "idiot scum"), (4, "idiot scum"), (4, "idiot scum")])
    out = toxicity.scored(docs, MODEL)
    assert out.count() == 6 and set(docs.columns) == set(out.columns) - {"predicted"}
    left = toxicity.accepted(docs, MODEL)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3]
    assert toxicity.scored(docs_of([]), MODEL).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for table in (labels, labels.limit(0)):
        model = toxicity.fit(docs, table)
        assert 0 <= model.score("any") <= 1
    assert toxicity.fit(docs_of([]), labels).stems == {}


def test_fitted_stems(spark, docs_of):
    name = lambda i: "w" + "".join("abcdefghij"[int(d)] for d in str(i))
    texts = [(i, f"{name(i)} grumk{'abcdefghij'[i % 10]}o {name(i + 1)}" if i % 2 else f"{name(i)} fine {name(i + 3)}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    stems = toxicity.fit(docs_of(texts), labels).stems
    assert any("grumkx".startswith(s) for s in stems) and "fine" not in stems


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site name</h1></header><div class="cookie-notice">We use cookies, please accept all of them now.</div>
<nav><a href=/>Home</a> <a href=/x>Other pages here</a></nav>
<div id=wrap><div class="sidebar"><p>Side text that is long enough to look dense as a paragraph.</p></div>
<div class="post"><h2>Title here</h2><div><p>First   para with a <a href=x>link</a> &amp; <b>bold</b> words, many of them, to fill the line.</p>
<p>Second &eacute;t&eacute; para&nbsp;here; more words to fill the line,<br>and yet more.</div>
<div><p>Third para in another part of the page, also with many words.</p><ul><li>one item<li>two items</ul></div></div>
<script>var t = "<p>no</p>";</script><div class="comments"><p>I liked this a lot, said a reader with many words.</p></div>
<form>Search <input name=q></form></div><footer>&copy; foot</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE).split("\n\n") == [
        "Title here", "First para with a link & bold words, many of them, to fill the line.",
        "Second été para here; more words to fill the line, and yet more.",
        "Third para in another part of the page, also with many words.", "one item", "two items",
    ]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text &lt;here&gt;", "just text <here>"), ("<p>a<p>b", "a\n\nb"), ("<html><body></body></html>", ""),
    ("<nav>only a menu</nav>", ""), ("<article><h1>t</h1><p><b>open <br></article><footer>f", "t\n\nopen"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("</div></p>stray", "stray"), ("<p>&#233;&#x41;&am", "éA&am"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_given_pages_by_their_article(spark):
    pages = E.queries()["op6_html_extraction"](spark, SF).collect()
    raw = {r.page_id: r.html for r in read_table(spark, SF, "pages").collect()}
    assert len(pages) == len(raw)
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = (" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, "x", "y"), (1, None, "x", "y"), (None, "<p>a</p>", None, "y")], "page_id int, html string, url string, _main string")
    out = html_extract.extracted(df)
    assert out.columns == [*df.columns, "text"] and sorted(r.text for r in out.collect()) == ["", "", "a"]
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    langs, rates = language_id.fit_text(docs.filter(~out))
    rows = docs.filter(out & (F.length("text") > 40)).select("text", "lang").collect()
    ll = language_id.log_likelihood([r.text for r in rows], rates, False)
    right = sum(langs[x.argmax()] == r.lang for x, r in zip(ll, rows))
    assert right >= 0.97 * len(rows)


def test_language_of_pages_and_documents(spark):
    rows = E.queries()["op3_language_id"](spark, SF).collect()
    pages, docs = [r for r in rows if r.page_id is not None], [r for r in rows if r.doc_id is not None]
    assert len(pages) == read_table(spark, SF, "pages").count() and len(pages) + len(docs) == len(rows)
    assert sum(r.lang == r.declared for r in pages) >= 0.9 * len(pages) and all(0.25 <= r.probability <= 1 for r in rows)
    lang = {r.doc_id: r.lang for r in read_table(spark, SF, "documents").collect()}
    assert len(docs) == len(lang) and sum(lang[r.doc_id] == r.lang for r in docs) >= 0.97 * len(docs)


def test_evidence_is_fused(spark, docs_of):
    docs = spark.createDataFrame([("the cat sat on the mat with the hat", "en"), ("der hund und die katze sind nicht hier", "de"), (None, "en"), ("x", None)], "text string, lang string")
    page = lambda t, lang: f"<html lang='{lang}'><body>{t}</body></html>"
    rows = [(f"https://www.blatt.de/{i}", page("der hund und die katze", "de")) for i in range(6)]
    rows += [(f"https://news.paper.uk/{i}", page("the cat sat with the hat", "en")) for i in range(6)]
    rows += [("https://www.blatt.de/none", None), ("https://news.paper.uk/none", ""), ("https://new.example/x", page("", "de")), (None, None), (None, None),
             ("https://www.blatt.de/wrong", page("der hund und die katze sind nicht hier", "en"))]
    table = spark.createDataFrame([(*r, "c", "c") for r in rows], "url string, html string, lang string, _own0 string")
    model = language_id.fit_text(docs)
    out = language_id.identified(table, model)
    assert out.count() == len(rows) and {"url", "html", "declared", "lang", "probability", "_own0"} == set(out.columns)
    got = {r.url: r.lang for r in out.collect()}
    assert got["https://www.blatt.de/none"] == "de" and got["https://news.paper.uk/none"] == "en"
    assert got["https://new.example/x"] == "de" and got["https://www.blatt.de/wrong"] == "de"
    assert language_id.identified(table.limit(0), model).count() == 0
    none = language_id.fit_text(docs.limit(0))
    assert {r.lang for r in language_id.identified(table, none).collect()} == {None}
    plain = docs_of([(1, "der hund und die katze sind nicht hier", "a"), (2, None, "a"), (2, None, "a"), (3, "", None), (None, "the cat sat with the hat", "b")])
    got = language_id.identified_documents(plain, model, plain.columns)
    assert got.count() == 5 and {(r.doc_id, r.lang) for r in got.collect()} >= {(1, "de"), (2, "de"), (None, "en")}
    assert language_id.identified_documents(plain.limit(0), model, ["doc_id"]).count() == 0


def clause_by_hand(model, words):
    """The grammar's rules one after another, without machines."""
    negated, reported, out = 0, False, 0.0
    target = any(w in toxicity.TARGETS for w in words)
    for w in words:
        context = (toxicity.NEGATED if negated else 1.0) * (toxicity.REPORTED if reported else 1.0)
        if insult := model.weight(w):
            out += insult * context * (toxicity.TARGETED if target else 1.0)
        elif w in toxicity.THREATS and target:
            out += toxicity.THREAT * context
        negated = toxicity.REACH if w in toxicity.NEGATIONS else max(0, negated - 1)
        reported = reported or w in toxicity.REPORTING
    return out


def test_composed_machines_equal_their_rules():
    import random

    r = random.Random(4)
    model = toxicity.Model({"grum": 2.5, "zork": 1.75, "kill": 1.5, "he": 3.0})
    words = ["grumble", "zorky", "killer", "kill", "hurt", "you", "he", "not", "never", "said", "wrote", "plain", "word", "other"]
    for _ in range(3000):
        clause = [r.choice(words) for _ in range(r.randint(0, 12))]
        assert abs(model.clause(clause) - clause_by_hand(model, clause)) < 1e-9
    assert len(toxicity.GRAMMAR.starts) == 2 and all(len(s) == 2 for s in toxicity.GRAMMAR.starts)
    assert model.clause(["grumble"]) == 2.5 and model.clause([]) == 0.0
    assert model.clause(["hurt", "you"]) == toxicity.THREAT and model.clause(["hurt"]) == 0.0
    assert model.clause(["never", "hurt", "you"]) == toxicity.THREAT * toxicity.NEGATED
    assert model.clause(["he", "said", "zorky"]) == (3.0 + 1.75 * toxicity.REPORTED) * toxicity.TARGETED
