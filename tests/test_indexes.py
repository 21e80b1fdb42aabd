"""Term postings, facet bitmaps, JSON forms and row numbers against plain Python."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.functions import json_values as js
from vellumine.operators import term_index
from vellumine.operators.facet_bitmaps import Choice, FacetBitmaps
from vellumine.operators.term_index import TermIndex
from vellumine.sources import spreadsheet
from vellumine.sources.scan_order import numbered

TEXTS = ["", None, "a", "ab", "abc abd", "数据分析 工程师", "xx😀yy", "b" * 3000, "zab", "ab c", "the abc", "ABC"]
TERMS = ["a", "ab", "abc", "bc a", "数据", "分析 工", "😀", "b" * 40, "nothing", " "]


def hits(text, terms):
    return sum(t in (text or "") for t in terms)


@given(st.lists(st.integers(0, 1 << 20), min_size=1, unique=True))
def test_gaps_come_back(rows):
    rows = np.array(sorted(rows))
    first = np.zeros(len(rows), bool)
    first[0] = True
    cells, ends = term_index.packed(rows, first)
    assert ends[-1] == len(cells) and term_index.unpacked(cells.tobytes()).tolist() == rows.tolist()


def test_no_gaps():
    assert term_index.unpacked(b"").tolist() == []


@settings(max_examples=200)
@given(st.text("abc数", max_size=30), st.text("abc数", min_size=1, max_size=5))
def test_contained_terms_have_their_grams(text, term):
    own = term_index.grams(text)
    has = all(((own >= low) & (own <= high)).any() for low, high in term_index.ranges_of(term))
    assert has or term not in text
    if len(term) < 3:
        assert has == (term in text)


def test_long_text_is_cut_into_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abcdef", k=1000))
    whole = term_index.grams(text).tolist()
    monkeypatch.setattr(term_index, "_PIECE", 7)
    assert term_index.grams(text).tolist() == whole


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "abc", "x"), (3, "ab", "y")]
    items = spark.createDataFrame(rows, "id long, body string, __text string").repartition(3)
    return rows, TermIndex.build(items, "id", F.col("body"), str(tmp_path_factory.mktemp("terms") / "t"))


@pytest.mark.parametrize("few", [10_000, 0])
@pytest.mark.parametrize("terms", [TERMS, ["abc"], ["a", "a"], ["nothing"], [], ["😀", "zab"]])
def test_postings_find_what_contains_finds(texts, terms, few, monkeypatch):
    rows, index = texts
    monkeypatch.setattr(term_index, "_FEW", few)
    distinct = set(terms)
    want = sorted(((i, hits(t, distinct) / len(distinct)) for i, t, _ in rows if distinct and hits(t, distinct)), key=str)
    assert sorted(map(tuple, index.search(terms).collect()), key=str) == want


def test_best_rows_read_few_folders(spark, tmp_path):
    texts = [f"common {'rare' if i % 50_000 < 7 else 'word'} {i}" for i in range(200_000)]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(2)
    index = TermIndex.build(items, "id", F.col("body"), str(tmp_path / "t"))
    found = index.best(["common", "rare"], 5)
    want = sorted(((-hits(t, ["common", "rare"]) / 2, i) for i, t in enumerate(texts)))[:5]
    assert [(-r["score"], r["id"]) for r in found.rows.collect()] == want
    folders = index.texts.select("__folder").distinct().count()
    assert found.folders < folders and found.postings < index.postings.count() / 10
    more = index.best(["common", "rare"], 50)
    assert more.folders == folders and more.rows.count() == 50
    assert more.rows.where("score = 1").count() == 28
    assert index.best(["absent"], 5).rows.count() == 0 and index.best([], 5).rows.count() == 0


def test_task_holds_few_grams_and_texts(spark, tmp_path, monkeypatch):
    """Postings are made of bounded pieces of a block, and only lengths go to Python to tell the blocks."""
    held = []
    monkeypatch.setattr(term_index, "_posted", lambda block, rows, found: held.append(sum(map(len, found))) or iter(()))
    texts = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for i in range(300)]
    batch = term_index.pa.RecordBatch.from_pydict({"block": [0] * 300, "row": list(range(300)), "text": texts})
    list(term_index._post(iter([batch])))
    assert max(held) <= 1 << 18 and sum(held) == sum(len(term_index.grams(t)) for t in texts)
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(term_index, "_HELD", 5000)
    index = TermIndex.build(spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(2), "id", F.col("body"), str(tmp_path / "t"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert index.postings.count() > index.postings.select("gram", "block").distinct().count()  # blocks in pieces
    for terms in (["abc"], ["qz", "e"], ["xyz", "zyx", "the"]):
        assert sorted(r["id"] for r in index.search(terms).collect()) == [i for i, t in enumerate(texts) if hits(t, terms)]


def test_blank_terms_are_refused(texts):
    with pytest.raises(ValueError, match="one character"):
        texts[1].search(["a", ""])


def test_index_of_no_rows(spark, tmp_path):
    index = TermIndex.build(spark.createDataFrame([], "id long, body string"), "id", F.col("body"), str(tmp_path / "t"))
    assert index.search(["a"]).count() == 0 and index.best(["a"], 3).rows.count() == 0


ITEMS = [(i, None if i % 7 == 0 else f"v{i % 3}", None if i % 11 == 0 else [None, *["x", "y", "x", "z"][: i % 5]]) for i in range(2000)]


@pytest.fixture(scope="module")
def bitmaps(spark, tmp_path_factory):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "id long, one string, many array<string>, value int").repartition(3)
    return FacetBitmaps.build(items, {"one": F.col("one"), "many": F.col("many"), "odd": F.col("id") % 2}, str(tmp_path_factory.mktemp("facets") / "t"))


def values_of(row):
    return {"one": {row[1]} - {None}, "many": set(row[2] or []) - {None}, "odd": {str(row[0] % 2)}}


def passes(row, choice, skip=None):
    held = values_of(row)
    loose = all(not held[f] or held[f] & set(v) for f, v in choice.any_of.items() if f != skip)
    return loose and all(bool(held[f] & set(v)) for f, v in choice.only.items() if f != skip)


CHOICES = [
    Choice(), Choice(any_of={"one": ["v1"]}), Choice(only={"many": ["y", "z"]}), Choice(any_of={"many": []}), Choice(only={"one": []}),
    Choice(any_of={"many": ["z"], "odd": ["1"]}, only={"one": ["v0", "absent"]}),
]


@pytest.mark.parametrize("choice", CHOICES)
def test_bitmaps_filter_and_count_as_the_rows_do(bitmaps, choice):
    want = [r for r in ITEMS if passes(r, choice)]
    assert sorted(r["id"] for r in bitmaps.select(choice).collect()) == [r[0] for r in want]
    assert bitmaps.select(choice).columns == ["id", "one", "many", "value"]
    assert tuple(bitmaps.totals(choice).first()) == (len(want), len(ITEMS))
    counts = {}
    for facet in ("one", "many", "odd"):
        for r in ITEMS:
            if passes(r, choice, facet):
                for v in values_of(r)[facet] or {None}:
                    counts[facet, v] = counts.get((facet, v), 0) + 1
    got = {(r["facet"], r["value"]): r["n"] for r in bitmaps.counts(choice, ["one", "many", "odd"]).collect()}
    assert got == counts


def test_bitmaps_of_many_blocks_and_of_none(spark, tmp_path):
    items = spark.range(0, 100_000, 1, 1)
    made = FacetBitmaps.build(items, {"rest": F.col("id") % 5}, str(tmp_path / "many"))
    assert made.bitmaps.where("facet = ''").count() == 4
    assert sorted(r["id"] for r in made.select(Choice(only={"rest": ["3"]})).collect()) == list(range(3, 100_000, 5))
    none = FacetBitmaps.build(items.limit(0), {"rest": F.col("id") % 5}, str(tmp_path / "none"))
    assert tuple(none.totals(Choice()).first()) == (0, 0) and none.select(Choice()).count() == 0 and none.counts(Choice(), ["rest"]).count() == 0


def test_clashing_names_and_double_choices_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="taken"):
        FacetBitmaps.build(spark.range(1).withColumnRenamed("id", "__row"), {}, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="once"):
        Choice(any_of={"a": []}, only={"a": []})


def shuffled(value, rng):
    if isinstance(value, dict):
        keys = list(value)
        rng.shuffle(keys)
        return {k: shuffled(value[k], rng) for k in keys}
    return [shuffled(v, rng) for v in value] if isinstance(value, list) else value


def test_digest_is_free_of_order_at_all_depths(spark):
    deep = {"z": 1, "a": None}
    for i in range(60):
        deep = {f"k{i}": deep, "list": [deep if i < 3 else i, {"b": 1, "a": "é数\n"}], "x": 1.5}
    rng = random.Random(3)
    forms = [json.dumps(shuffled(deep, rng), ensure_ascii=bool(i % 2), indent=i or None) for i in range(6)]
    other = json.dumps(deep | {"x": 2.5})
    rows = spark.createDataFrame([(f,) for f in [*forms, other]], "j string").select(js.digest(F.col("j")).alias("d"), js.canonical(F.col("j")).alias("c")).collect()
    assert len({r["d"] for r in rows[:-1]}) == 1 and rows[-1]["d"] != rows[0]["d"]
    assert json.loads(rows[0]["c"]) == deep


def test_lists_keep_their_order_and_odd_texts_stay(spark):
    texts = ["[1,2]", "[2,1]", '{"a":1,"a":2}', "no json", "", None, " 1 ", '"x"', "null"]
    rows = spark.createDataFrame([(t,) for t in texts], "j string").select(js.canonical(F.col("j")).alias("c"), js.is_object(F.col("j")).alias("o")).collect()
    assert [r["c"] for r in rows] == ["[1,2]", "[2,1]", '{"a":1,"a":2}', "no json", "", None, "1", '"x"', "null"]
    assert not any(r["o"] for r in rows)


def test_merges_of_nested_objects(spark):
    def merged(old, new):
        o, n = (x if isinstance(x, dict) else {} for x in (old, new))
        out = o | n
        a, b = o.get("in"), n.get("in")
        if isinstance(a, dict) or isinstance(b, dict):
            out["in"] = (a if isinstance(a, dict) else {}) | (b if isinstance(b, dict) else {})
        return out

    each = [None, 3, {}, {"a": 1, "b": [1, {"c": 2}]}, {"a": None}, {"in": {"p": 1, "q": {"r": 1}}, "a": 2}, {"in": {"q": 5}}, {"in": "text"}, {"in": None}]
    pairs = [(a, b) for a in each for b in each]
    rows = spark.createDataFrame([tuple(None if x is None else json.dumps(x) for x in p) for p in pairs], "o string, n string")
    got = [json.loads(r[0]) for r in rows.coalesce(1).select(js.merged_objects(F.col("o"), F.col("n"), ["in"])).collect()]
    assert got == [merged(*p) for p in pairs]


def test_merges_parse_each_text_once(spark):
    rows = spark.createDataFrame([("{}", "{}")], "o string, n string").coalesce(1)
    parsed = []
    for nested in ([], ["in"], ["in", "of"]):
        plan = rows.select(js.merged_objects(F.col("o"), F.col("n"), nested).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
        parsed.append(sum(plan.lower().count(f) for f in ("parsejson", "parse_json")))
    assert parsed[0] > 0 and parsed[2] - parsed[1] == parsed[1] - parsed[0] <= 2 and parsed[2] < 10


def test_entries_are_set_and_asked_for(spark):
    rows = spark.createDataFrame([('{"a":{"b":null}}', "[1]"), (None, "no"), ("[]", None), ('{"k":1}', '{"z":1,"y":2}')], "j string, v string").coalesce(1)
    got = rows.select(js.with_entry(F.col("j"), "k", F.col("v")).alias("t"), js.has_key(F.col("j"), "a").alias("a")).collect()
    assert [r["t"] for r in got] == ['{"a":{"b":null},"k":[1]}', '{"k":null}', '{"k":null}', '{"k":{"y":2,"z":1}}']
    assert [r["a"] for r in got] == [True, False, False, False]


def test_row_numbers_of_split_files(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 50)}" for i in range(20_000)]
    for name, part in (("a", lines[:12_000]), ("b", lines[12_000:]), ("c", [])):
        (tmp_path / f"{name}.csv").write_text("".join(f"{x}\n" for x in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        scan = spark.read.csv(str(tmp_path), schema="n int, t string")
        assert scan.rdd.getNumPartitions() > 5
        rows = numbered(scan).select("n", F.element_at(F.split("file", "/"), -1).alias("file"), "row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["n"], r["file"], r["row_number"]) for r in rows) == [(i, *(("a.csv", i + 1) if i < 12_000 else ("b.csv", i - 11_999))) for i in range(20_000)]
    with pytest.raises(ValueError, match="taken"):
        numbered(spark.read.csv(str(tmp_path), schema="file string"))


def test_sheet_rows_have_numbers_in_their_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("﻿2026-01-01,A,,,,,,,,,,,x\n2026-01-02,\"two\nlines, \"\"quoted\"\"\",\n2026-01-03,C\n", encoding="utf-8")
    (tmp_path / "two.csv").write_text("2026-02-01,D\n", encoding="utf-8")
    rows = spreadsheet.read_csv(spark, str(tmp_path)).orderBy("file", "row_number").collect()
    assert [(r["row_number"], r["updated_at"], r["company_name"]) for r in rows] == [
        (1, "2026-01-01", "A"), (2, "2026-01-02", 'two\nlines, "quoted"'), (3, "2026-01-03", "C"), (1, "2026-02-01", "D"),
    ]
