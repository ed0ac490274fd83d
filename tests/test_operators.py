"""Operators on literal rows; expected values are worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import ailang, authors, diffs, docmodel, markers, metadata, overlap, refparse, scoring, sentences, styles, webcheck
from quireflow.sources import files

REF = "index int, authors array<string>, year string, title string, journal string, volume string, issue string, pages string, doi string, raw string"


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'int'}" for n, v in columns.items())) if columns else spark.range(1)
    return df.select(expression.alias("v")).first()["v"]


def ref(spark, index=1, authors=("Smith, John", "Jones, Alice"), year="2020", title="Test Title", journal="Nature", volume="10", issue=None, pages="1-5", doi=None):
    return spark.createDataFrame([(index, list(authors), year, title, journal, volume, issue, pages, doi, "raw")], REF)


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name", ["Smith, John", "John Smith", "Smith J", "Smith J.", "Smith"])
def test_surname(spark, name):
    assert value(spark, authors.surname(F.col("a")), a=name) == "Smith"


@pytest.mark.parametrize("token, want", [("J", True), ("JK", True), ("J.", True), ("John", False), ("jk", False)])
def test_initials(spark, token, want):
    assert value(spark, authors.is_initials(F.col("a")), a=token) is want


def test_normalised_author(spark):
    assert tuple(value(spark, authors.normalised(F.col("a")), a="Smith, John")) == ("Smith", "J.")
    assert tuple(value(spark, authors.normalised(F.col("a")), a="Smith JK")) == ("Smith", "J.")


def test_markers_of_styles(spark):
    assert one(ref(spark, authors=("Smith, J", "Jones, A", "Brown, B")), styles.FIRST.marker("apa")) == "(Smith et al., 2020)"
    assert one(ref(spark), styles.FIRST.marker("apa")) == "(Smith & Jones, 2020)"
    assert "n.d." in one(ref(spark, year=None), styles.FIRST.marker("apa"))
    assert one(ref(spark, index=3), styles.FIRST.marker("vancouver")) == "[3]"
    assert one(ref(spark, index=2), styles.SECOND.marker("nature")) == "²"
    assert one(ref(spark, authors=()), styles.FIRST.marker("apa")) == "(Nature, 2020)"
    assert ".." not in one(ref(spark, title="A study."), styles.FIRST.entry("apa"))
    with pytest.raises(ValueError):
        styles.FIRST.marker("unheard-of")


def test_entry_of_an_unknown_style_is_raw(spark):
    assert one(ref(spark), styles.FIRST.entry("unheard-of")) == "1. raw"


def test_chunks_of_many_lengths(spark):
    docs = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 4, 9, 10, 59, 60, 61, 101)], "doc_id long, text string")
    got = {}
    for r in overlap.chunks(docs, "doc_id", "text").collect():
        got.setdefault(r["doc_id"], []).append((r["word_start"], r["word_end"]))
    assert {k: sorted(v) for k, v in got.items()} == {10: [(0, 10)], 59: [(0, 59), (40, 59)], 60: [(0, 60), (40, 60)], 61: [(0, 60), (40, 61)], 101: [(0, 60), (40, 100), (80, 101)]}


def test_overlap_is_whole_and_bounded(spark):
    text = " ".join(f"word{i} thing{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "nothing in common here at all with any of the others, really not one bit")], "doc_id long, text string")
    found = overlap.matches(docs, spark.createDataFrame([(7, text)], "item_id long, text string"))
    total = {r["doc_id"]: r for r in overlap.summary(docs, found).collect()}
    assert total[1]["flagged"] == total[1]["words"] == 120 and total[1]["label"] == "HIGH RISK"
    assert total[2]["flagged"] == 0 and total[2]["label"] == "LIKELY ORIGINAL"


def test_expand_numbers(spark):
    assert value(spark, T.expand_numbers(F.col("a")), a="1,2-4") == [1, 2, 3, 4]
    assert value(spark, T.expand_numbers(F.col("a")), a="3-1") == []


def test_spans(spark):
    assert [tuple(s) for s in value(spark, T.spans(F.col("a"), r"\d+"), a="é12 x3")] == [(1, 3, "12"), (5, 6, "3")]


def test_sentences():
    text = "Smith et al. (2020) found 3.5 things. J. Jones agreed! Was it so? yes. The End"
    assert [s["text"] for s in sentences.split(text, sentences.CITING)] == ["Smith et al. (2020) found 3.5 things.", "J. Jones agreed!", "Was it so? yes.", "The End"]
    for s in sentences.split(text, sentences.DETECTING):
        assert text[s["start"] : s["end"]] == s["text"]


def test_first_line_goes_without_a_heading(spark):
    docs = spark.createDataFrame([(1, "Title line\nThis is the body sentence. And another one here."), (2, "Lost text before.\nIntroduction\nKept sentence number one.\nReferences\n[1] gone")], "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["section"]) for r in docmodel.document_sentences(docs).orderBy("doc_id", "idx").collect()]
    assert got == [(1, "This is the body sentence.", "unknown"), (1, "And another one here.", "unknown"), (2, "Kept sentence number one.", "introduction")]


@pytest.mark.parametrize("text, section, want", [
    ("We found that cells grow.", "results", "author_own"), ("However, it was shown.", "results", "transition"), ("Plates were washed.", "methods", "author_own"),
    ("A network was trained.", "methods", "method"), ("Smith showed that cells grow.", "results", "claim"), ("Cells are small.", "results", "background"),
])
def test_role(spark, text, section, want):
    assert value(spark, docmodel.role(F.col("a"), F.col("b")), a=text, b=section) == want


def test_scores_hit_the_thresholds(spark):
    s = spark.createDataFrame([(1, 0, "Miller showed that cells grow.", "results", "claim"), (1, 1, "Miller University showed growth.", "results", "claim"), (1, 2, "We saw Miller.", "results", "author_own")], "doc_id long, idx int, text string, section string, role string")
    r = spark.createDataFrame([(1, 1, "Miller", "1999", "Unrelated matter", "J")], "doc_id long, index int, surname string, year string, title string, journal string")
    got = scoring.scored(s, r).collect()
    assert [(m["idx"], round(m["score"], 6), m["auto"]) for m in got] == [(0, 0.55, True)]


def test_split_and_parse(spark):
    sample = "Body citing Smith et al. (2020) here.\n\nReferences\nSmith, J. (2020). First title. Journal, 1, 1-5.\nJones, A. (2019). Second title. Journal, 2, 6-9.\n"
    docs = spark.createDataFrame([(1, sample), (2, "no references here")], "doc_id long, text string")
    parts = {r["doc_id"]: r for r in refparse.split_references(docs).collect()}
    assert "Smith et al." in parts[1]["body"] and "Smith, J." in parts[1]["refs"]
    assert (parts[2]["body"], parts[2]["refs"]) == ("no references here", "")
    rows = refparse.parsed(refparse.entries(refparse.split_references(docs))).orderBy("index").collect()
    assert [(r["first_surname"], r["year"], r["title"]) for r in rows] == [("Smith", "2020", "First title"), ("Jones", "2019", "Second title")]


def test_numbered_entries(spark):
    refs = spark.createDataFrame([(1, "[1] Smith J. First title of it. Lancet. 2020;10(2):1-5.\nwrapped line\n[2] Jones A. Second title of it. Lancet. 2019;3:7-9.")], "doc_id long, refs string")
    rows = refparse.parsed(refparse.entries(refs)).orderBy("index").collect()
    assert [(r["format"], r["year"], r["volume"], r["issue"], r["pages"], r["journal"]) for r in rows] == [("vancouver", "2020", "10", "2", "1-5", "Lancet"), ("vancouver", "2019", "3", None, "7-9", "Lancet")]


def test_author_lists(spark):
    assert value(spark, refparse.authors(F.col("a")), a="Smith J and Jones A") == ["Smith J", "Jones A"]
    assert len(value(spark, refparse.authors(F.col("a")), a="Smith J; Jones A; Brown B")) == 3
    assert len(value(spark, refparse.authors(F.col("a")), a="Smith, J., Jones, A., & Brown, B.")) == 2
    assert [a["surname"] for a in value(spark, refparse.author_structs(F.col("a")), a="Smith, J., Jones, A., & Brown, B.")] == ["Smith", "Jones", "Brown"]


def test_entries_second(spark):
    text = "1. First entry that is long enough.\n   wrapped\n\n2. Second entry that is long enough."
    assert value(spark, refparse.entries_second(F.col("a")), a=text) == ["1. First entry that is long enough.    wrapped", "2. Second entry that is long enough."]


def test_inserted_by_mention(spark):
    docs = spark.createDataFrame([(1, "As Smith (2020) says, cells grow. Brown University is far.")], "doc_id long, text string")
    refs = ref(spark, authors=("Smith, J.",)).withColumn("doc_id", F.lit(1)).unionByName(ref(spark, index=2, authors=("Brown, B.",), year="2001").withColumn("doc_id", F.lit(1)))
    assert markers.cited(docs, refs, "apa").first()["cited"] == "As Smith (Smith, 2020) says, cells grow. Brown University is far."
    assert markers.cited(docs, refs, "vancouver").first()["cited"] == "As Smith (2020) [1] says, cells grow. Brown University is far."


def test_stripping_without_markers_is_the_identity(spark):
    docs = spark.createDataFrame([(1, "Nothing [9] to see (Nobody, 1900) here.")], "doc_id long, text string")
    d = markers.with_references(docs, ref(spark).withColumn("doc_id", F.lit(1)), "apa")
    found = markers.inventory(F.col("text"), F.col("refs"))
    assert d.select(markers.stripped(F.col("text"), found).alias("v")).first()["v"] == "Nothing [9] to see (Nobody, 1900) here."


def test_detector_needs_enough_words(spark):
    docs = spark.createDataFrame([(1, "Too short to judge at all."), (2, "It is important to note that this robust framework plays a crucial role. " * 4), (3, None)], "doc_id long, text string")
    got = ailang.documents(ailang.analysed(docs)).collect()
    assert [r["doc_id"] for r in got] == [2] and got[0]["overall_percent"] > 40 and got[0]["flagged_count"] == 4


def test_differences(spark):
    assert [tuple(x.values()) for x in diffs._chunks("a b c", "a b [1] c")] == [("norm", "a b "), ("inserted", "[1] "), ("norm", "c ")]
    assert value(spark, diffs.marked_html(F.col("a")), a="x < [1]") == 'x &lt; <mark class="cite">[1]</mark>'


def test_metadata(spark):
    assert value(spark, metadata.clean_doi(F.col("a")), a=" https://doi.org/10.1/x ") == "10.1/x"
    item = '{"title":"T","pubdate":"2019 Jan","authors":[{"name":"A B"}],"source":"J","articleids":[{"idtype":"pubmed","value":"1"},{"idtype":"doi","value":"10.1/z"}]}'
    r = value(spark, metadata.pubmed(F.col("a"), F.lit("1")), a=item)
    assert (r["year"], r["doi"], r["raw"]) == ("2019", "https://doi.org/10.1/z", "A B. (2019). T. J. https://doi.org/10.1/z")
    assert value(spark, metadata.json_in(F.col("a")), a='Sure:\n```json\n{"a": 1}\n``` done') is not None


def test_query_phrase_takes_the_first_of_equals(spark):
    s = "the alpha bravo charlie delta echo foxtrot golfing hotel india of it"
    assert value(spark, webcheck.query_phrase(F.col("a")), a=s) == "alpha bravo charlie delta echo foxtrot golfing hotel india"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"line one\r\nline two")
    (tmp_path / "b.docx").write_bytes(files.docx_bytes("first <para>\nsecond"))
    (tmp_path / "c.csv").write_text("x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.txt", "zipped")
        z.writestr("__MACOSX/in.txt", "hidden")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "line one\nline two" and got["b.docx"]["text"] == "first <para>\nsecond" and "unsupported" in got["c.csv"]["error"]
    assert [r["text"] for r in files.read_zips(spark, str(tmp_path)).collect()] == ["zipped"]
    assert zipfile.is_zipfile(io.BytesIO(bytes(value(spark, files.as_docx(F.col("a")), a="x"))))


def test_stream(spark, tmp_path):
    from quireflow.streaming import checks

    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30)) + ".")], checks.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    sources = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30)))], "item_id long, text string")
    q = checks.each_batch(checks.document_stream(spark, str(tmp_path / "in")), sources, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/overlap")).first()["label"] == "HIGH RISK"


def test_overlaps_of_sentences_against_brute_force(monkeypatch):
    kinds = [{"a", "b"}, {"b", "c", "d"}, set(), {"x"}, {"a", "b"}, {"d", "e"}]
    want = [max((len(x & y) / len(x | y) for j, y in enumerate(kinds) if j != i and x | y), default=0) for i, x in enumerate(kinds)]
    assert list(ailang.greatest_overlaps(kinds)) == want
    monkeypatch.setattr(ailang, "CELLS", 0)
    assert list(ailang.greatest_overlaps(kinds)) == want and list(ailang.greatest_overlaps([{"a"}])) == [0]
    text = "alpha bravo charlie delta echo. two three. alpha bravo charlie golf hotel. alpha bravo alpha bravo india."
    repeated, grams, _ = ailang.repeats([s["text"] for s in sentences.split(text.replace(". ", ".\n\"").strip(), sentences.DETECTING)])
    assert (list(repeated), list(grams)) == ([3, 0, 3, 1], [7, 0, 7, 6])


@pytest.mark.parametrize("roll_up", [ailang.documents, ailang.paragraph_reports])
def test_detector_makes_no_rows_of_pairs(spark, roll_up):
    docs = spark.createDataFrame([(1, "The same few words again and again here. " * 40)], "doc_id long, text string")
    found = roll_up(ailang.analysed(docs))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert found.count() == 1 and {r["redundancy"] for r in ailang.analysed(docs).collect()} == {1.0}


def test_query_phrase_looks_every_word_up_once(spark):
    df = spark.createDataFrame([("the of alpha, it. bravo charlie the delta echo foxtrot golfing hotel india of it",), ("one two",), (None,)], "a string").select(webcheck.query_phrase(F.col("a")).alias("v"))
    assert [r["v"] for r in df.collect()] == ["bravo charlie the delta echo foxtrot golfing hotel india", "one two", ""]
    assert "filter(slice" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_web_check_looks_for_a_phrase_once_and_keeps_its_first_page(spark):
    line = "alpha bravo charlie delta echos foxtrot golfing hotels indigo juliet kilos limas."
    short = "of | the | it | is | to | and | by | on | in | at | as | no"  # makes no match by itself, so all its pages are kept
    docs = spark.createDataFrame([*[(i, f"{line} Word{i} is of it.") for i in range(40)], (50, short), (51, None), (52, "")], "doc_id long, text string")
    held = "".join(x for x in short if x != "|")
    pages = [(i, "u", f"<title>T</title><p>page {i} {line} {'more ' * i}</p>") for i in range(60, 0, -1)] + [(0, "v", ""), (1, "x", "<p>another of that number</p>"), *[(i, "w", f"<p>{held} {'some ' * (72 - i)}</p>") for i in (70, 71, 72)]]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    asked = [r["asked"] for r in webcheck.queries(docs).select(T.normalise(F.col("phrase")).alias("asked")).collect()]
    p = pages.select("page_id", F.concat(F.lit(" "), T.normalise(webcheck.page_text(F.col("html"))), F.lit(" ")).alias("page"))
    p = p.withColumn("shingles", T.shingles(F.split(F.trim("page"), " ")))
    found = webcheck.first_pages(spark.createDataFrame([(x,) for x in asked], "asked string"), p, "page_id").collect()
    assert len(asked) == 41 and sorted(r["page_id"] for r in found) == [1, 70, 71, 72]
    assert {(r["doc_id"], r["page_id"], r["url"], r["risk"]) for r in webcheck.check(docs, pages).collect()} == {(i, 1, "u", "HIGH") for i in range(40)} | {(50, 70, "w", "HIGH")}
