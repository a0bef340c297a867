import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.functions.chunking import _pack_each, _pack_spans, _sentences, chunk_documents, chunks_of, pack, size_of, slice_bytes
from docquarry.functions.text import WHITE


def test_table_repeats_its_header():
    table = "| Isle | Lamps |\n|:--|--:|\n| Skye | 12 |\n| Mull | 7 |\n| Jura | 31 |\n| Eigg | 5 |\n"
    head = "| Isle | Lamps"
    got = chunks_of(table, 40)  # header 16 bytes, rows 12 to 13: two rows pass the limit of 40
    assert got == [f"{head} \n| Skye | 12 \n| Mull | 7", f"{head} \n| Jura | 31 \n| Eigg | 5", head]
    assert chunks_of(table, 200) == [f"{head} \n| Skye | 12 \n| Mull | 7 \n| Jura | 31 \n| Eigg | 5"]


def test_code_stays_whole():
    text = "Before it.\n\n~~~ sql\nselect a\n  from b\n\n where c\n~~~\nBehind it, in more words than fit."
    assert chunks_of(text, 12) == ["Before it.", "```\nselect a\n  from b\n\n where c\n```", "Behind it, i", "n more words", " than fit."]
    assert chunks_of("```\none\n```\n```\ntwo\n```\n\n    three", 4) == ["```\none\n```", "```\ntwo\n```", "```\nthree\n```"]
    long = "```\n" + "y" * 8184 + "\n```"
    assert chunks_of(long, 800) == [long] and [len(x) for x in chunks_of(long.replace("y", "yy", 1), 800)] == [800] * 10 + [193]
    assert chunks_of("para\n\n    kept\n      in\n", 800) == ["para", "```\nkept\n  in\n```"]


def test_sentences_overlap_by_one():
    a, b, c, d = "Rain fell early.", "Wind rose!", "Did it stop?", "Night came on."
    assert chunks_of(f"{a} {b} {c} {d}", 30) == [f"{a} {b}", f"{b} {c}", f"{c} {d}"]
    assert chunks_of(f"{a} {b}\n{c} {d}", 18) == [a, f"{a} {b}", f"{b} {c}", f"{c} {d}"]  # the repeated sentence may pass the limit
    giant = "g" * 41 + "."
    assert pack(f"{a} {giant} {b}", 20) == [a, giant[:20], giant[20:40], giant[40:], b]


def test_small_limits_and_wide_characters():
    assert slice_bytes("𝄞ß𝄞𝄞", 7) == ["𝄞ß", "𝄞", "𝄞"]
    assert slice_bytes("ß𝄞", 1) == ["ß", "𝄞"]
    assert chunks_of("m" * 29, 8) == ["m" * 8] * 3 + ["m" * 5]
    assert chunks_of("Two words", 2) == ["Tw", "o ", "wo", "rd", "s"]


def test_mixed_document():
    text = "Lead in.\n\n| K |\n|---|\n| 9 |\n\n```\nloop\n```\n# Part\n- x\n- y\n\nClosing."
    assert chunks_of(text, 30) == ["Lead in.", "| K \n| 9", "```\nloop\n```", "Partx", "y", "Closing."]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# Title\n\nBody", ["TitleBody"]),
        ("Title\n=====\n\nBody", ["TitleBody"]),
        ("- a\n- b\n", ["a", "b"]),
        ("- a\n  - b\n- c", ["ab", "c"]),
        ("- a\n\n- b\n", ["a", "b"]),
        ("1. one\n2. two", ["one", "two"]),
        ("- [x] done\n- [ ] open", ["done", "open"]),
        ("> quoted\n> text\n\nafter", ["quoted\ntext", "after"]),
        ("a [link](http://x.y 'z') and ![alt *t*](i.png) `co``de` **b** _i_ ~~s~~", ["a link and alt t co``de b i s"]),
        ("see [ref] and [text][ref] and [none]\n\n[ref]: http://x", ["see ref and text and [none]"]),
        ("a\\*b &amp; &lt; &bogus; <b>c</b> <http://u.v> x<!-- y -->z", ["a*b & < &bogus; c http://u.v xz"]),
        ("<div>\nhidden\n</div>\n\nshown", ["shown"]),
        ("a  \nb\\\nc\nd", ["a\nb\nc\nd"]),
        ("a\n\n---\n\n***\n\nb", ["a", "b"]),
        ("2 * 3 * 4 and snake_case_name and *** stars", ["2 * 3 * 4 and snake_case_name and *** stars"]),
        ("***both*** and **a *b* c**", ["both and a b c"]),
        ("no | table\nhere | too", ["no | table\nhere | too"]),
        ("~~~\ncode\n", ["```\ncode\n```"]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_markdown(text, want):
    assert chunks_of(text, 800) == want


def test_heading_separator():
    assert chunks_of("# A\n\nB\n\nC\n=\n- D", 800, ": ") == ["A: B", "C: D"]


@settings(max_examples=60, deadline=None)
@given(st.text(), st.integers(1, 30))
def test_slices_rejoin(text, limit):
    got = slice_bytes(text, limit)
    assert "".join(got) == text
    assert all(size_of(x) <= max(limit, 4) for x in got)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\né", max_size=200), st.integers(4, 40))
def test_every_sentence_is_packed(text, limit):
    packed = "".join(pack(text, limit)).replace(" ", "")
    for part in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        assert part.strip(WHITE).replace(" ", "")[:1] in packed or not part.strip(WHITE)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .!?\n\té\r", max_size=200), st.integers(1, 40))
def test_packing_by_places_equals_packing_one_by_one(text, limit):
    spans = _sentences(np.frombuffer(text.encode(), np.uint8)) if text else None
    if spans is not None:
        assert _pack_spans(*spans, limit) == _pack_each(text, limit)


def test_packing_of_long_texts():
    words = ["Short one.", "A sentence of some more words, it is!", "x" * 90 + ".", "é" * 50 + "?", "two\nlines", " " * 5]
    text = " ".join(words[i * i % 6] for i in range(3000))
    assert len(text) > 32_768 and pack(text, 80) == _pack_each(text, 80) and pack(text, 800) == _pack_each(text, 800)
    for odd in (text + "\u3000end. " * 9, text + " " * 500 + "end."):
        assert pack(odd, 120) == _pack_each(odd, 120)


def test_ten_megabytes():
    text = "Ein Satz über Flüsse. 長い川の話 ends here, кто знает?\n" * 150_000
    begun = time.perf_counter()
    got = chunks_of(text, 600)
    assert sum(map(size_of, got)) >= 9_000_000 and max(map(size_of, got)) <= 1201 and time.perf_counter() - begun < 30


def test_rows_of_chunks(spark):
    docs = spark.createDataFrame([("a", "[x]: y\n\n# H\n\nsee [x].\n"), ("b", ""), ("c", None), ("d", "  \n"), ("e", "é. " * 600)], "source_path string, text string")
    got = chunk_documents(docs, 800).orderBy("source_path", "chunk_index").collect()
    assert [(r["source_path"], r["chunk_index"], r["text"]) for r in got if r["source_path"] != "e"] == [("a", 0, "Hsee x.")]
    assert [r["chunk_index"] for r in got if r["source_path"] == "e"] == list(range(len(got) - 1)) and len(got) > 2
