"""License templates: what the automata accept, against regular expressions made of the same markup."""

import random
import re

import pytest

from framewright.llm.licenses import TEMPLATES, as_pattern, compile_template, parse, scan_licenses, words_of

MIT = next(m for label, m in TEMPLATES if label == "mit" and len(m) > 500)


def filled(markup: str, rng: random.Random) -> str:
    """One text that a template stands for."""

    def build(nodes):
        out = []
        for kind, value in nodes:
            if kind == "word":
                out.append(value.decode())
            elif kind == "any":
                out += rng.choices(["zzz", "foo", "1", "the"], k=rng.randint(0, value))
            elif rng.random() < 0.5:
                out += build(value)
        return out

    return " ".join(build(parse(markup)))


def accepted(label: str, markup: str, text: str) -> bool:
    t, words = compile_template(label, markup), words_of(text.encode())
    return any(t.match(words, i) is not None for i in range(len(words)))


@pytest.mark.parametrize("label, markup", TEMPLATES)
def test_every_template_accepts_its_own_texts_and_no_changed_ones(label, markup):
    rng = random.Random(len(markup))
    t, pattern = compile_template(label, markup), re.compile(" " + as_pattern(markup))
    for _ in range(20):
        words = words_of(filled(markup, rng).encode())
        assert t.match(words, 0) == len(words)
        changed = words.copy()
        changed[rng.randrange(len(changed))] = b"changed"
        joined = " " + b" ".join(changed).decode() + " "
        assert any(t.match(changed, i) is not None for i in range(len(changed))) == bool(pattern.search(joined))


def test_markup():
    assert accepted("x", "one [[two [[three]] four]] five", "ONE two, four five.")
    assert accepted("x", "one [[two [[three]] four]] five", "one five")
    assert not accepted("x", "one [[two [[three]] four]] five", "one two three five")
    assert accepted("x", "one {{name:2}} two", "one a b two") and not accepted("x", "one {{name:2}} two", "one a b c two")
    assert accepted("x", "[[{{a:3}}]] one {{b:3}}", "one"), "regions at either end need not be there"
    for bad in ("one [[two", "one ]] two", "[[one]]", "{{a:3}}"):
        with pytest.raises(ValueError, match="region|mandatory"):
            compile_template("x", bad)


def test_longest_and_not_overlapping(spark):
    docs = spark.createDataFrame([(1, "b a a a a a c")], "doc_id long, text string")
    (row,) = scan_licenses(docs, templates=[("x", "a [[a]] a")]).collect()
    assert [(p.start, p.end) for p in row.places] == [(1, 4), (4, 6)], "the longest first, then what is left"


def test_scan(docs):
    full = re.sub(r"\[\[|\]\]", "", MIT).replace("{{work:8}}", "this software").replace("{{name:3}}", "Software")
    full = full.replace("{{name:4}}", "the Software")
    rows = [
        (1, f"Copyright 2020 Someone\n\n{full}\n"),
        (2, full.replace("without restriction", "with restriction")),
        (3, "Licensed under CC BY-NC 4.0. mit license MIT License; GNU General  Public-License"),
        (4, None),
        (5, ""),
        (5, ""),
        (None, "Apache License"),
        (6, "word " * 300_000 + "mit license " + "permission is hereby " * 2000),
        (7, "xmit license mit licenses ćc by"),
    ]
    out = scan_licenses(docs(*rows))
    assert out.columns == ["doc_id", "text", "kept", "n_words", "places"], "a column of a new name is replaced, others stay"
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [(p.kind, p.label, p.start) for p in r.places]))
    assert got[1][0][1] == [("template", "mit", 3)] and got[2][0][1] == []
    words, places = got[3][0]
    assert words == 15 and [p for p in places if p[0] == "phrase"] == [("phrase", "cc-by", 2), ("phrase", "mit", 7), ("phrase", "mit", 9), ("phrase", "gpl", 11)]
    assert {p[1] for p in places if p[0] == "template"} == {"cc-by", "cc-by-nc"}
    assert got[4] == [(0, [])] and got[5] == [(0, []), (0, [])] and got[None] == [(2, [("phrase", "apache", 0)])]
    assert got[6] == [(306_002, [("phrase", "mit", 300_000)])] and got[7][0][1] == []


def test_empty_table(docs):
    assert scan_licenses(docs((1, "x")).filter("doc_id > 1")).collect() == []
