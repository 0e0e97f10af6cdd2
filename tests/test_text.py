import hashlib
import hmac
import json
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import hashing, jsontext, pages, selectors, text

ORDERS = json.dumps(
    {
        "orders": [
            {"no": 7, "open": True, "lines": [{"sku": "a", "n": 2}, {"sku": "b"}], "note": None},
            {"no": 8, "open": False, "lines": []},
            {"no": 9, "lines": [{"sku": "c", "n": 1}]},
        ],
        "shop": {"name": "North", "zip": "007"},
        "7": "seven",
    }
)
# What each selector picks, from the rules: members and indexes, wildcards, filters, pointers.
SELECTED = [
    (ORDERS, "$.orders[*].no", [7, 8, 9]),
    (ORDERS, "$.orders[*].lines[*].sku", ["a", "b", "c"]),
    (ORDERS, "$.orders[*].lines[-1].sku", ["b", "c"]),
    (ORDERS, "$.orders[?@.open == true].no", [7]),
    (ORDERS, "$.orders[?@.open != true].no", [8, 9]),
    (ORDERS, "$.orders[?@.open].no", [7, 8]),
    (ORDERS, "$.orders[?@.note == null].no", [7]),
    (ORDERS, "$.orders[?@.no == 9].lines[*].n", [1]),
    (ORDERS, "$.orders[0].note", [None]),
    (ORDERS, "$.orders[-3].no", [7]),
    (ORDERS, "$.orders[-4].no", []),
    (ORDERS, "$.orders[3]", []),
    (ORDERS, "$.shop.zip.first", []),
    (ORDERS, "$.shop[0]", []),
    (ORDERS, "$.shop.*", ["North", "007"]),
    (ORDERS, "$['shop']['name']", ["North"]),
    (ORDERS, '$["7"]', ["seven"]),
    (ORDERS, "$", [json.loads(ORDERS)]),
    (ORDERS, "", [json.loads(ORDERS)]),
    (ORDERS, "/7", ["seven"]),
    (ORDERS, "/orders/2/lines/0/sku", ["c"]),
    (ORDERS, "/orders/02", []),
    (ORDERS, "/orders/-1", []),
    ("[false, 0, 0.0, \"0\", null]", "$[?@ == 0]", [0, 0.0]),
    ("[false, 0, 0.0, \"0\", null]", "$[?@ == false]", [False]),
    ('{"say": "don\'t", "no": "dont"}', "$[?@ == 'don\\'t']", ["don't"]),
    ('{"x/y": {"~": 5}}', "/x~1y/~0", [5]),
    ('{"q": {"late": 1, "early": 2}, "b": 3}', "$.q.*", [1, 2]),
    ('{"q": {"late": 1, "early": 2}, "b": 3}', "$.*", [{"late": 1, "early": 2}, 3]),
    ("[[[4]], [], [[5, 6]]]", "$[*][*][*]", [4, 5, 6]),
    ('{"ñandú": [1]}', "$.ñandú[0]", [1]),
    ('{"two\\"marks\'": 4}', "$['two\"marks\\'']", [4]),
]


def test_selectors(spark):
    for document, selector, expected in SELECTED:
        df = spark.createDataFrame([(document,)], "t string").withColumn("v", F.parse_json("t"))
        items = df.select(F.transform(selectors.select(F.col("v"), selector, F.col("t")), lambda v: F.to_json(v)).alias("i")).first().i
        assert [json.loads(i) for i in items] == expected, selector


@pytest.mark.parametrize(
    "selector",
    ["$.shop..zip", "$.orders[1:]", "$[?@.no < 8]", "$.two words", "orders", "shop.name", "$[?@.no != ]", "$[\"open", "$.orders[", "/a~", "$['a'b]"],
)
def test_selectors_outside_the_subset_are_refused(selector):
    with pytest.raises(ValueError):
        selectors.parse(selector)


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("r")).first().r


def test_lines_lose_their_bullets(spark):
    bullets = ["- ", "* ", "• ", "3. ", "14) ", ""]
    things = ["tea", "two cups", "12 . spoons", "-sugar"]
    listed = "\n \n".join(f"  {bullets[i % len(bullets)]}{t} \r" for i, t in enumerate(things * 6)) + "\x85end\x0bstop"
    assert one(spark, listed, text.lines) == [*(things * 6), "end", "stop"]


def test_folding_is_pythons_for_every_character(spark):
    # Letters and marks alone can fold; in one text each, since folding may depend on neighbours.
    cased = [c for c in map(chr, range(1, sys.maxunicode + 1)) if c.casefold() != c or c.upper() != c]
    df = spark.createDataFrame(pd.DataFrame({"c": cased})).select("c", text.fold(F.col("c")).alias("f"))
    assert [r.c for r in df.collect() if r.f != r.c.casefold()] == []


def test_strip_is_pythons(spark):
    spaced = "".join(c for c in map(chr, range(0x3100)) if c.isspace()) + "a b" + " \x1c\n"
    assert one(spark, spaced, text.strip) == spaced.strip()


def test_cleanup_ops(spark):
    messy = "\r\n  line one\r\n\r\n\r\nline two  \n"
    ops = ["newlines.lf@1", "blank_lines.collapse@1", "strip@1"]
    assert one(spark, messy, lambda t: text.clean(t, ops)) == "line one\n\nline two"


    def by_row(*lists):
        rows = spark.createDataFrame([(i, messy, names) for i, names in enumerate(lists)], "i int, t string, ops array<string>")
        return [r.t for r in text.clean_by(rows, "t", "ops").orderBy("i").collect()]

    six = [*ops, "unicode.nfc@1", *ops[1:]]
    assert by_row(ops, [], six, None) == ["line one\n\nline two", messy, "line one\n\nline two", messy]
    with pytest.raises(Exception, match="no cleanup op"):
        by_row(["strip@2"])


def test_units_start_where_they_say(spark):
    body = "😀 One. Two!  Three\n\nfour? five.\n six"
    found = one(spark, body, text.units)
    assert [u.unit for u in found] == ["😀 One.", "Two!", "Three", "four?", "five.", " six"]
    assert all(body[u.start :].startswith(u.unit) for u in found)
    for n, u in enumerate(found):
        assert one(spark, body, lambda t, n=n: text.unit_start(t, F.lit(n))) == u.start


def test_words_are_placed_in_long_texts(spark):
    body = "ab, ß-c. " * 3000
    found = one(spark, body, text.words_at)
    assert len(found) == 9000
    assert all(body[w.start :].startswith(w.word if w.word != "ss" else "ß") for w in found)


def test_words_lines_are_those_of_each_text(spark):
    texts = ["Acute MI.", "", "ÅSA's\x01Σ", "  ...", "ß"]
    got = one(spark, texts, text.words_lines, "array<string>")
    each = [one(spark, t, text.words_line) for t in texts]
    assert got == each == [" acute mi ", " ", " åsa s σ ", " ", " ss "]
    assert one(spark, [], text.words_lines, "array<string>") == []


def test_snippets_are_cut_at_a_word(spark):
    assert one(spark, " a  b\nc ", text.snippet) == '"a b c"'
    assert one(spark, "word " * 20, text.snippet) == '"' + " ".join(["word"] * 8) + '…"'
    assert one(spark, "x" * 50, text.snippet) == '"' + "x" * 41 + '…"'


def test_hmac_is_pythons(spark):
    for key in (b"k", b"long" * 40):
        got = one(spark, "vignette", lambda t: hashing.hmac_fingerprint(t, key))
        assert got == hmac.new(key, b"vignette", hashlib.sha256).hexdigest()


def test_spaced_json(spark):
    value = {"a,:\"b": [1, "x\\", {"c": None}], "d": "e: f"}
    compact = json.dumps(value, separators=(",", ":"))
    assert one(spark, compact, jsontext.spaced) == json.dumps(value)


def test_canonical_json_is_as_others_write_it(spark):
    for value in ("plain", "a\x0bb\x1f\x01\x7f", "\\u000B", "\\\x0b\\\\\x1b", "tab\tnew\nback\b\f\r", "é\u2028\U0001f600\"/"):
        made = one(spark, value, lambda t: hashing.canonical({"z": F.lit(1), "k": t}))
        assert made == json.dumps({"k": value, "z": 1}, separators=(",", ":"), ensure_ascii=False)
        assert one(spark, value, jsontext.quoted) == json.dumps(value, ensure_ascii=False)


def test_results_of_a_search_page(spark):
    html = (
        '<a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx%3Fy%3D1&amp;rut=2">A &amp; <b>B</b></a>'
        '<a class="result__snippet" href="#">Some\n<b>text</b> </a>'
        '<a class="result__a" href="https://b.org/?uddg=no">C</a> <a class="result__snippet">D</a>'
    )
    page = spark.createDataFrame([(1, html)], "page int, html string")
    found = pages.results(page, "html", ["page"])
    rows = [tuple(r) for r in found.orderBy("rank").collect()]
    assert rows == [(1, 1, "A & B", "https://a.org/x?y=1", "Some\ntext"), (1, 2, "C", "https://b.org/?uddg=no", "D")]
    assert pages.as_text(found, ["page"]).first().text.startswith("1. A & B\n   https://a.org/x?y=1\n   Some")
    assert pages.results(page, "html", ["page"], first=1).count() == 1
