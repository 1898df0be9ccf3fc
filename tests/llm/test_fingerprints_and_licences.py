import hashlib
import math

import pytest

from flowsentry.llm.fingerprints import Parse, fingerprints, likeness
from flowsentry.llm.licences import TEMPLATES, scan

from .conftest import ODD


def phrases(raw):
    seen, start = set(), 0
    for end in range(1, len(raw) + 1):
        if raw[start:end] not in seen:
            seen.add(raw[start:end])
            start = end
    return seen


def test_a_parse_can_be_continued():
    raw = b"abracadabra abracadabra abracadabra"
    for cut in range(len(raw)):
        assert Parse().extended(raw[:cut]).extended(raw[cut:]).phrases == phrases(raw)


def test_likeness_of_small_sets_is_exact():
    a, b = Parse().extended(b"one two three four").signature(), Parse().extended(b"one two three five").signature()
    x, y = phrases(b"one two three four"), phrases(b"one two three five")
    assert likeness(a, b) == pytest.approx(len(x & y) / len(x | y))
    empty = Parse().signature()
    assert likeness(empty, empty) == 1 and likeness(a, empty) == 0 and likeness(a, a) == 1


def brute(rows):
    ordered = sorted(((-(1 << 63) if i is None else i), t or "", i) for i, t in rows)
    out = []
    for k, (_, text, i) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        own, other, after = (Parse().extended(t.encode()).signature() for t in (text, edited, following))
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(),
                    other.tobytes().hex(), likeness(own, other), likeness(own, after)))
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_fingerprints_equal_brute_force(docs, table, ranges):
    for frame in (table("documents").limit(60), docs(*ODD), docs((1, "single"))):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        found = fingerprints(frame, ranges=ranges).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in found) == brute(rows)
    assert fingerprints(docs(*ODD).limit(0), ranges=ranges).count() == 0


def test_ranges_of_repeated_ids(docs):
    rows = [(i // 7, f"text {i % 5}") for i in range(60)]
    found = fingerprints(docs(*rows), ranges=5).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == brute(rows)


def test_licences_own_inherited_and_none(spark):
    rows = [("a/LICENSE", "Released under the MIT License\n" + "x " * 500), ("a/b/c/f.py", "code only"), ("a/b/g.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 50),
            ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("z/f.py", "nothing"),
            ("z/g.py", "They license the song to the public"), (None, None), ("a/b/c/f.py", "code only"), ("h.py", ""),
            ("y/notice", "All rights reserved."), ("y/deep/er/file", "words"), ("q/only", "Licensed under CC BY-NC 4.0"), ("q/r/s", None)]
    found = {}
    files = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "'clash' AS term", "1 AS own")
    for r in scan(files).collect():
        found.setdefault(r.path, []).append((r.licence, r.origin, r.from_folder))
    assert found["a/LICENSE"] == [("MIT", "own", None)]
    assert found["a/b/c/f.py"] == [("GPL-3.0", "inherited", "a/b")] * 2
    assert found["a/b/g.py"] == [("Apache-2.0", "own", None)]
    assert found["z/f.py"] == found["z/g.py"] == [(None, "none", None)]
    assert found[""] == found["h.py"] == [(None, "none", None)]
    assert found["y/deep/er/file"] == [("Proprietary", "inherited", "y")]
    assert found["q/r/s"] == [("CC-BY-NC-4.0", "inherited", "q")]
    assert sum(map(len, found.values())) == len(rows) and scan(files.limit(0)).count() == 0


def test_every_template_is_found_in_its_own_words(spark):
    rows = [(f"{i}.txt", f"prose before it\n{text}.\nprose after it") for i, (_, text) in enumerate(TEMPLATES)]
    found = {r.path: (r.own_licence, r.own_score) for r in scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for i, (name, _) in enumerate(TEMPLATES):
        assert found[f"{i}.txt"][0] == name and found[f"{i}.txt"][1] > 0.95


def test_common_words_around_a_statement_weigh_little(spark):
    common = "it as for you copyright this article is under by the terms of published all rights corp example"
    plain = spark.range(20_000).selectExpr("concat('plain/', id) AS path", f"'{common}' AS text")
    rows = [("a", "This article is licensed under CC BY 4.0"), ("c", "Copyright Example Corp, all rights reserved"),
            ("b", "it as for you copyright this work is licensed under the GNU General Public License, version 2")]
    found = {r.path: r for r in scan(plain.union(spark.createDataFrame(rows, "path string, text string"))).filter("own_licence IS NOT NULL").collect()}
    assert {p: r.own_licence for p, r in found.items()} == {"a": "CC-BY-4.0", "b": "GPL-2.0", "c": "Proprietary"}
    # by hand: idf of a term of 20,001 to 20,003 of 20,003 files is 1 to 1e-4, of one of 2 files or of 1 file this
    rare = {1: math.log(20_004 / 2) + 1, 2: math.log(20_004 / 3) + 1}
    both = 3 * rare[1] ** 2 + rare[2] ** 2 + 2  # cc, 4, 0; licensed; under, by
    assert found["a"].own_score == pytest.approx(math.sqrt(both / (both + 3)), abs=1e-4)


def test_wrapped_statements_keep_their_version(spark):
    gpl = ["This work is licensed under the GNU General Public", "License, version 3."]
    rows = [("a/x.py", "# " + "\n# ".join(gpl) + "\n#\n# other words\n" + "code " * 90), ("b/x.c", "/*\r\n * " + "\r\n * ".join(gpl) + "\r\n */"),
            ("c/word_by_word", "\n".join(" ".join(gpl).split())), ("b/below/y.c", "int x;"),
            ("d/none", "This work is licensed under the GNU General Public License"),
            ("e/v3", "This work is licensed under the GNU General Public License v3"), ("f/blank", gpl[0] + "\n\n" + gpl[1]),
            ("g/two", "This work is licensed under the GNU General Public\nLicense, version 2"), ("h", "\n" * 50_000 + "\n".join(gpl))]
    found = {r.path: r for r in scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    own = {p: r.own_licence for p, r in found.items()}
    assert own == {"a/x.py": "GPL-3.0", "b/x.c": "GPL-3.0", "c/word_by_word": "GPL-3.0", "b/below/y.c": None, "d/none": None,
                   "e/v3": "GPL-3.0", "f/blank": None, "g/two": "GPL-2.0", "h": "GPL-3.0"}
    assert found["a/x.py"].own_score == found["c/word_by_word"].own_score == 1
    assert (found["b/below/y.c"].licence, found["b/below/y.c"].from_folder) == ("GPL-3.0", "b")


def test_no_python_on_the_native_path(spark, table):
    from flowsentry.llm.queries import RULES
    from flowsentry.llm.urltrust import judge
    for frame in (judge(table("pages"), RULES), scan(table("documents").selectExpr("source AS path", "text"))):
        assert not any(x in frame._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
