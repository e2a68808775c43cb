"""Note shapes of all eras through one parse: who is cited, under which title, type and address."""

import pytest

from glossa.plans import build

HOST = "https://www.vatican.va"
URL = HOST + "/content/{}/en/encyclicals/documents/hf_x_enc_2000010{}_t.html"


def page(notes, title="T", extra=""):
    body = "".join(f'<p><a name="_ftn{i}" href="{extra}#_ftnref{i}">[{i}]</a> {n}</p>' for i, n in enumerate(notes, 1))
    return f"<html><head><title>{title}</title></head><body><p>Body.</p>{body}</body></html>"


PAGES = {
    "junk": page(["Cf. <i>,</i>", "2 <i>Pt</i> 3:13", "<i>Ep</i>. 204"]),
    "apparatus": page(["Pius XI, <i>QuadragesimoAnno</i>, AAS 23 (1931) 221", "Saint Augustine, <i>De Trinitate</i>, PL 42; Origen, <i>In Joh</i>", "Cf. <i>Iura et Bona,</i>"]),
    "merge": page(["Thomas Aquinas, <i>Summa Theologiae</i>, I", "St. Thomas, <i>Summa Theol</i>.", "<i>Summa theologica</i>"]),
    "relative": page(['Benedict XVI, Christmas Address to the Curia: <a href="/content/b/en/speeches/documents/hf_20051222_curia.html">Curia</a>']),
    "modifier": page(["Pius XII, Radio Message <i>Nell'alba</i>"]),
    "leaks": page(["Cf.Pontifical Council, <i>Compendium</i>", '"a phrase", Leo XIII, <i>Arcanum</i>', "Cf. <i>Bare</i>"]),
    "back": page(["Saint Augustine, <i>Confessions</i>"], extra="/content/x/documents/doc.html"),
    "ibid_first": page(["Ibid., 3", "Idem, <i>Work</i>"]),
    "endnotes": page(["A, <i>B</i>"]).replace("_ftn", "_edn"),
    "precedence": page(["A, <i>B</i>"]) + "<p>NOTES</p><p>1. Stray</p><p>2. Stray</p>",
    "legacy": "<html><head><title>T</title></head><body><p>b</p><hr><p>(1) Leo XIII's encyclical <i>Rerum</i>.<br>(2) <i>Ps</i> 8:2<br>(3) Pius XI, <i>Quadra</i><br></p><footer>(4) <i>No</i></footer></body></html>",
}


@pytest.fixture(scope="module")
def cites(spark):
    rows = [(i, True, URL.format(k, i), h) for i, (k, h) in enumerate(PAGES.items())]
    parsed = build.parse(spark.createDataFrame(rows, "doc_ord int, is_source boolean, url string, html string"))
    names = list(PAGES)
    out = {k: [] for k in names}
    for r in parsed["citations"].orderBy("doc_ord", "cite_seq").collect():
        out[names[r["doc_ord"]]].append(r)
    out["notes"] = {names[r["doc_ord"]]: r["footnote_count"] for r in parsed["documents"].collect()}
    return out


def test_junk_is_no_title(cites):
    assert cites["junk"] == []


def test_apparatus(cites):
    assert [(r["author"], r["title"]) for r in cites["apparatus"]] == [("Pius XI", "Quadragesimo Anno"), ("Saint Augustine", "De Trinitate"), (None, "Iura et Bona")]


def test_one_work_of_three_spellings(cites):
    assert {(r["target_key"], r["author_key"], r["doc_type"]) for r in cites["merge"]} == {("doc:work:summa-theologiae", "thomas aquinas", "Scholastic treatise")}


def test_relative_link_and_modifier(cites):
    r = cites["relative"][0]
    assert (r["author"], r["doc_type"], r["url"], r["target_key"]) == ("Benedict XVI", "Address", HOST + "/content/b/en/speeches/documents/hf_20051222_curia.html", "doc:hf_20051222_curia")
    assert [(r["author"], r["doc_type"]) for r in cites["modifier"]] == [("Pius XII", "Message")]


def test_no_leaks(cites):
    assert [(r["author"], r["title"]) for r in cites["leaks"]] == [("Pontifical Council", "Compendium"), ("Leo XIII", "Arcanum"), (None, "Bare")]


def test_absolute_back_link_and_endnotes(cites):
    assert [r["author"] for r in cites["back"]] == ["Saint Augustine"] and cites["notes"]["back"] == 1
    assert [(r["author"], r["title"]) for r in cites["endnotes"]] == [("A", "B")]


def test_ibid_without_a_work(cites):
    assert [(r["author"], r["title"]) for r in cites["ibid_first"]] == [(None, "Work")]


def test_strategies(cites):
    assert cites["notes"]["precedence"] == 1 and cites["notes"]["legacy"] == 3
    assert [(r["footnote"], r["author"], r["title"]) for r in cites["legacy"]] == [(1, "Leo XIII", "Rerum"), (3, "Pius XI", "Quadra")]
