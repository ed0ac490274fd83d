"""Queries over whole tables against brute force, where the SQL of their namesakes covers a part."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quireflow.functions import vocabulary as V
from quireflow.operators import ailang, markers, refparse, scoring, webcheck
from quireflow.operators.authors import surname
from quireflow.operators.docmodel import document_sentences
from quireflow.plans import reference_queries
from quireflow.plans.ailang_queries import CASES
from quireflow.plans.manuscripts import references
from quireflow.plans.marker_queries import bodies

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="test tables are not here")


def rows(spark, name, sf_dir=SF):
    return entry.queries()[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def refs(spark):
    """(index, surname, year) of the references of every document, in order."""
    out = defaultdict(list)
    for r in references(spark, SF).withColumn("s", surname(F.get("authors", F.lit(0)))).orderBy("doc_id", "index").collect():
        out[r["doc_id"]].append((r["index"], r["s"], r["year"]))
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sentences_brute(text):
    parts = re.split(r"(?<=[.!?])\s+(?=[A-Z])", re.sub(r"\s+", " ", text or "", flags=re.A), flags=re.A)
    return [p.strip(" ") for p in parts if len(p.split(" ")) - p.split(" ").count("") >= 12]


def phrase_brute(sentence):
    w = [x for x in sentence.split(" ") if x]
    content = [x.lower().strip(".,;:") not in V.OVERLAP_STOPWORDS and len(x) > 3 for x in w]
    return " ".join(w[(at := max(range(len(w) - 8), key=lambda i: (sum(content[i : i + 9]), -i))) : at + 9])


def clamp(x):
    return max(0.0, min(1.0, x))


def signals_brute(text):
    w, low = [x.lower() for x in re.findall("[A-Za-z][A-Za-z'-]*", text)], text.lower()
    n = len(w)
    if n < 5:
        return None
    share = lambda xs: sum(x in xs for x in w)
    starts = w[0] in V.STYLE_TRANSITIONS or " ".join(w[:2]) in ("in addition", "as a")
    phrase = sum(weight for p, weight, _ in V.STYLE_PHRASES if re.search(p, low)) + 0.08 * starts
    predictability = share(V.STYLE_COMMON) / n * 0.65 + (1 - len(set(w)) / n) * 0.25 + 0.1 * (sum(map(len, w)) / n < 5.2)
    genericity = share(V.STYLE_GENERIC) / n * 3.4 + 0.12 * (share(V.STYLE_HEDGES) >= 2)
    content = sum(x not in V.STYLE_STOPWORDS and len(x) > 2 for x in w)
    specific = len(list(re.finditer(V.STYLE_SPECIFIC, text))) * 0.35 + len(re.findall(r"\b[A-Z][a-z]{3,}\b", text)) * 0.08 + content / n * 0.65
    return (n, phrase, clamp(predictability), clamp(genericity), clamp(1 - min(1, specific)))


def page_text_brute(html):
    raw = html.encode()[:15000].decode("utf-8", "ignore")
    return re.sub(r"\s+", " ", re.sub("&[a-z]+;", " ", re.sub("<[^>]+>", " ", raw)), flags=re.A)[:3000]


def test_page_texts_of_long_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    assert any(len(h.encode()) > 15000 for h in pages.values())
    assert {r["page_id"]: r["text"] for r in rows(spark, "page_texts", LARGER)} == {k: page_text_brute(h) for k, h in pages.items()}


def test_page_text_at_a_cut_character(spark):
    pages = ["<p>" + "<b>" * 4900 + "x" * i + c * 400 for c in "é中😀" for i in range(5)] + ["short é", ""]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    assert {r["i"]: r["t"] for r in df.select("i", webcheck.page_text(F.col("html")).alias("t")).collect()} == {i: page_text_brute(h) for i, h in enumerate(pages)}


def test_confidence_of_all_kinds_of_markers(spark, refs):
    want = {}
    for d, items in refs.items():
        named = Counter((s, y) for _, s, y in items if s and y)
        for i, s, y in items:
            hits = 1 if d % 3 == 0 else named[s, y] if d % 3 == 1 else 0
            want[d, i] = 95 if hits >= 3 else (0, 75, 85)[hits]
    got = rows(spark, "reference_confidence")
    assert {(r["doc_id"], r["idx"]): r["confidence"] for r in got} == want and any(v and d % 3 == 1 for (d, _), v in want.items())
    assert all((r["status"], r["tier"]) == {0: ("✗ not found", "none"), 75: ("✓ cited", "medium")}.get(r["confidence"], ("✓ cited", "high")) for r in got)
    means = {d: [want[d, i] for i, _, _ in items] for d, items in refs.items()}
    for r in rows(spark, "confidence_summaries"):
        of = means.pop(r["doc_id"])
        assert (r["total"], r["cited"]) == (len(of), sum(v > 0 for v in of)) and abs(r["avg_confidence"] - sum(of) / len(of)) <= 0.0501
    assert not means


def test_web_phrases_in_any_language(spark, documents):
    want = {d: list(dict.fromkeys(map(phrase_brute, sentences_brute(text))))[:20] for d, text in documents.items()}
    got = defaultdict(list)
    for r in rows(spark, "web_phrases"):
        got[r["doc_id"]].append(r["phrase"])
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items() if x}


def test_sentence_signals_in_any_language(spark, documents):
    want = {(d, i): signals_brute(s) for d, text in documents.items() for i, s in enumerate(sentences_brute(text))}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        want |= {(-r["p_partkey"], i): signals_brute(f"{c} {r['p_name']}") for i, c in enumerate(CASES)}
    want = {k: v for k, v in want.items() if v}
    got = {(r["doc_id"], r["pos"]): (r["n"], r["phrase"], r["predictability"], r["genericity"], r["low_specificity"]) for r in rows(spark, "ai_sentence_signals")}
    assert got.keys() == want.keys()
    bad = [(k, got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], abs=2e-6)]
    assert not bad, bad[:3]


def test_markers_of_every_body(spark, refs):
    body = {r["doc_id"]: r["text"] for r in bodies(spark, SF).collect()}
    numbers = {d: ",".join(str(i) for i, _, _ in items) if d % 3 == 0 else "" for d, items in refs.items()}
    assert {r["doc_id"]: r["numbers"] for r in rows(spark, "cited_numbers")} == numbers and body.keys() == refs.keys()
    for name, kind in (("numbered_reformatted", 0), ("named_reformatted", 1)):
        got = {r["doc_id"]: r["cited"] for r in rows(spark, name)}
        changed = {r["doc_id"]: r["cited"] for r in rows(spark, name)}
        assert got == {d: changed[d] if d % 3 == kind else text for d, text in body.items()}
        assert sum(got[d] != body[d] for d in body) > len(body) / 4


@pytest.mark.parametrize("sentence", [
    "alpha | bravo | charlie | delta | echo foxtrot golfing hotels indigo",
    "state-of-the-art methods l'eau aujourd'hui well-known results follow from long-standing practice elsewhere entirely",
    "alpha bravo charlie delta echos foxtrot golfing hotels indigo juliet kilos limas",
])
def test_phrases_that_normalise_to_any_number_of_words_are_found(spark, sentence):
    docs = spark.createDataFrame([(1, sentence + " of the very last words.")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "u", f"<p>{sentence[:45]} nothing more</p>"), (2, "v", f"<title>T</title><p>Here is {sentence} of the very last words.</p>")], "page_id long, url string, html string")
    assert [(r["doc_id"], r["page_id"]) for r in webcheck.check(docs, pages).collect()] == [(1, 2)]


def test_bibliographies_of_short_entries_count_none(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create table part as select * replace (x as p_partkey, 44 as p_size) from (select * from '{SF}/part.parquet' limit 1), (values (58121), (48944), (7)) v(x)")
    con.execute(f"create table lineitem as select * replace (x as l_orderkey, y as l_partkey) from (select * from '{SF}/lineitem.parquet' limit 1), (values (1, 58121), (2, 7), (3, 48944), (3, 7)) v(x, y)")
    for t in ("part", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = sorted(con.execute(f"select doc_id, body, n_first, n_second from ({entry.oracle_sql()['references_split']})").fetchall())
    assert sorted(tuple(r[c] for c in ("doc_id", "body", "n_first", "n_second")) for r in rows(spark, "references_split", str(tmp_path))) == want
    assert 0 in [w[2] for w in want]


@pytest.mark.parametrize(("name", "parser"), [("entries_parsed", "parsed"), ("entries_parsed_second", "parsed_second")])
def test_entries_are_parsed_once_for_each_part(spark, tmp_path, monkeypatch, name, parser):
    """Many documents cite few parts; two of these have no field at all, so that a number is all of their entries."""
    import duckdb

    con, blank = duckdb.connect(), 17 * 23 * 19 * 5 * 7
    con.execute(f"create table part as select * from '{SF}/part.parquet' where p_partkey <= 12 union all select l.* replace (k as p_partkey, 44 as p_size) from (select * from '{SF}/part.parquet' limit 1) l, (values ({blank}), ({4 * blank})) v(k)")
    con.execute(f"create table lineitem as select l.* replace (o::int as l_orderkey, p_partkey as l_partkey) from (select * from '{SF}/lineitem.parquet' limit 1) l, part, range(1, 41) r(o) where (p_partkey + o) % 4 > 0")
    for t in ("part", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    parse, given = getattr(refparse, parser), []
    monkeypatch.setattr(refparse, parser, lambda entries, *rest: given.append(entries) or parse(entries, *rest))
    got = rows(spark, name, str(tmp_path))
    assert len(got) == 5 * con.execute("select count(*) from lineitem").fetchone()[0]
    bare = sum(len(r["raw"]) < 6 and r["style"] in ("vancouver", "ieee", "nature") for r in got)
    assert bare and sum(d.count() for d in given) <= 5 * con.execute("select count(*) from part").fetchone()[0] + bare
    whole = parse(reference_queries._entries(spark, str(tmp_path)))
    key = lambda r: (r["doc_id"], r["idx"], r["style"])
    want = {key(r): r.asDict() for r in whole.collect()}
    for r in got:
        w = want.pop(key(r))
        if parser == "parsed":
            w["authors"] = ";".join(w["authors"])
        else:
            names = [a["surname"] for a in w["authors"]]
            who = f"Ref {w['idx']}" if not names else f"{names[0] if len(names) == 1 else ' & '.join(names) if len(names) == 2 else names[0] + ' et al.'} ({w['year'] or 'n.d.'})"
            w |= {"label": who, "authors": ";".join(f"{a['surname']}, {a['initials']}" for a in w["authors"])}
        assert r.asDict() == w
    assert not want


def test_the_second_parser_searches_once(spark):
    """Of all entries: lines are read once, parts are dealt out before their fields are made, and names are searched once for each group."""
    plan = entry.queries()["entries_parsed_second"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(s_") == 2 == plan.count(refparse.RUN), plan
    assert plan.count("Relation [l_orderkey") == 1 and plan.count("Relation [p_partkey") == 2, plan
    dealt = plan[plan.index("RepartitionByExpression"):].split("\n")[1:]
    assert not any("transform(" in line for line in dealt), plan
    texts = ["Smith, J. K., Jones, A. (2020). T. J, 3(2), 1-9.", "", None, "Lee, X. and Mary Ann Brown; van der Berg, J. 1999a Rest", "10.2000/5 A and B", "Et al. 2001", "A. Smith, B C 2004"]
    e = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = {r["i"]: [tuple(a) for a in r["authors"]] for r in refparse.parsed_second(e).collect()}
    assert got[0] == [("Smith", "J. K."), ("Jones", "A.")] and got[1] == got[2] == got[5] == []


def test_sentences_are_placed_without_carrying_the_text(spark):
    """The line and paragraph of every sentence, in one pass: no copy of a text, or search of it, for each of its sentences."""
    texts = ["One here.\r\n \t\r\nTwo there. Three\nis long.\n\n\n  Four. Five.\n", "  \n\n Lead. \n \n\n Then \u00e9t\u00e9 \U0001f600 on.\n\x1c\nLast.", "", None, "A line. " * 300 + "\n\n" + "B line.\n" * 300]
    df = ailang.split_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = defaultdict(list)
    for r in df.orderBy("doc_id", "pos").collect():
        got[r["doc_id"]].append((r["start"], r["line"], r["paragraph"]))
    for d, text in enumerate(texts):
        clean = re.sub("\r\n?", "\n", text or "")
        paras = [m.start() for m in re.finditer(r"\S(?:(?!\n\s*\n).)*", clean, re.S | re.A)]
        assert got[d] == [(at, clean.count("\n", 0, at) + 1, max(1, sum(p <= at for p in paras))) for at, _, _ in got[d]]
    assert [x[1:] for x in got[0]] == [(1, 1), (3, 2), (3, 2), (7, 3), (7, 3)] and len(got[4]) == 600
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Generate posexplode\(\w+#\d+\), \[doc_id#\d+L\], true", plan), plan


def test_the_second_pipeline_scores_once(spark):
    """Markers travel with the sentences and one pass of scores gives all counts, as joins of markers and two passes do."""
    refs = references(spark, SF).withColumn("surname", surname(F.get("authors", F.lit(0))))
    d = markers.with_references(bodies(spark, SF), references(spark, SF), "apa").withColumn("found", markers.inventory(F.col("text"), F.col("refs")))
    sentences = document_sentences(d.select("doc_id", F.concat(F.lit("\n"), markers.stripped(F.col("text"), F.col("found"))).alias("text")))
    matches = scoring.scored(sentences, refs, scoring.at_sentences(d.select("doc_id", F.inline("found")), sentences)).collect()
    best, at = defaultdict(dict), defaultdict(set)
    for m in matches:
        best[m["doc_id"]][m["index"]] = max(m["score"], best[m["doc_id"]].get(m["index"], 0))
        if m["auto"]:
            at[m["doc_id"]].add(m["idx"])
    converted = {r["doc_id"]: len(r["found"]) for r in d.select("doc_id", "found").collect()}
    total = Counter(r["doc_id"] for r in refs.select("doc_id").collect())
    want = {(k, n, auto := sum(x >= scoring.AUTO for x in best[k].values()), len(best[k]) - auto, n - len(best[k]), converted[k], len(at[k]) or None) for k, n in total.items()}
    df = entry.queries()["pipeline_second"](spark, SF)
    assert {tuple(r) for r in df.collect()} == want and any(w[-1] for w in want) and any(w[-1] is None for w in want)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
