import pytest
from strandline.llm import licenses


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.lookup(docs).collect()}


def test_whole_texts_in_other_spellings(spark):
    texts = [
        licenses.MIT, "Copyright (c) 2020 Someone\n\n" + licenses.MIT.upper(), "The MIT Licence (MIT)\n\n(c) 1999 X\n" + licenses.MIT.replace("\n", "\n  ").replace(",", ""),
        licenses.ZLIB.replace("acknowledgment", "acknowledgement"), licenses.MIT + " and more", licenses.MIT[:-20], "", None,
        "/* * " + licenses.WTFPL.replace("\n", "\n * "), "plain text",
    ]
    got = found(spark, texts)
    assert [got[i]["license"] for i in range(len(texts))] == ["MIT", "MIT", "MIT", "Zlib", None, None, None, None, "WTFPL", None]


def test_lines_and_paragraphs(spark):
    got = found(spark, ["Words first.\nLicensed under the Apache License, Version 2.0.\nmore", "a\n\n" + licenses.WTFPL + "\n\nb\nReleased under the MIT Licence.\n", "Released under the MIT License. And so on"])
    assert [(got[i]["part_licenses"], got[i]["n_parts"]) for i in range(3)] == [("Apache-2.0", 1), ("MIT,WTFPL", 2), ("", 0)]


def test_every_known_text_is_found(spark):
    got = found(spark, [t for _, t in licenses.KNOWN])
    assert [got[i]["license"] for i in range(len(licenses.KNOWN))] == [k for k, _ in licenses.KNOWN]


@pytest.mark.parametrize("rows", [[], [(None, None, "x")], [(1, "a", "x"), (1, "a", "y")], [(1, "license " * 20000, "x")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert licenses.lookup(docs).count() == len(rows)
    assert licenses.lookup(docs, known=()).count() == len(rows)


def test_standard_wrapped_forms(spark):
    import textwrap

    def wrapped(text, width=72, mark=""):
        return "\n\n".join("\n".join(mark + x for x in textwrap.wrap(p, width)) for p in text.split("\n\n"))

    isc = wrapped(licenses.ISC).replace("that the above\ncopyright", "that the above copyright").replace("above copyright notice", "above\ncopyright notice")
    long = [(k, t) for k, t in licenses.WHOLE if k not in ("MIT", "ISC")]
    texts = [isc, "Copyright (c) 2020, A B\nAll rights reserved.\n\n" + isc] + [t for _, t in long] + ["Copyright The Authors\n\n" + wrapped(t, 60, "# ") for k, t in long if k.startswith("BSD")]
    got = found(spark, texts)
    assert [got[i]["license"] for i in range(len(texts))] == ["ISC", "ISC", *(k for k, _ in long), *(k for k, _ in long if k.startswith("BSD"))]


def test_whole_licences_inside_a_text(spark):
    gpl = dict(licenses.WHOLE)["GPL-3.0"]
    texts = ["A project.\n\nCopyright 2021 X\n\n" + licenses.MIT + "\n\nThe end.", "Read me\n\n" + gpl + "\n\n" + licenses.ISC, "Read me\n\n" + licenses.MIT[:-9]]
    got = found(spark, texts)
    assert [(got[i]["license"], got[i]["part_licenses"], got[i]["n_parts"]) for i in range(3)] == [(None, "MIT", 1), (None, "GPL-3.0,ISC", 2), (None, "", 0)]


def test_known_texts_of_any_words(spark):
    known = (("X", "you may copy this freely forever"), ("Y", "do as you do"), ("Z", "50 per cent of Copyright Owner Centre"))
    texts = ["intro\nYou may copy: this freely, forever.\nmore words", "Do as you do", "50 percent of copyright holder center", "nothing of this", "you may copy this freely", "the 50 PER CENT, of copyright owner centre!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["part_licenses"]) for r in licenses.lookup(docs, known, ()).collect()}
    assert got[0] == (None, "X") and got[1] == ("Y", "Y") and got[2][0] == "Z" and got[3] == got[4] == (None, "")


def test_telling_words_are_in_every_text_of_the_form(spark):
    rng = __import__("random").Random(7)
    forms = [f for _, f in licenses.known_forms(spark, licenses.KNOWN + licenses.WHOLE, licenses.canonical)]
    words = licenses.telling_words(forms)
    assert all(any(w in f for w in words) for f in forms) and len(words) < 25
    back = {new: old for old, new in licenses.SPELLINGS}
    for f in forms:
        raw = "".join(rng.choice([x.upper(), x.title(), x]) + rng.choice([" ", "\n", ", ", " - "]) for x in (back.get(w, w) for w in f.split()))
        assert any(w in raw.lower() for w in words)
