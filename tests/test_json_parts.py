"""Large JSON arrays in parts: against json.loads, at every part size."""

import json

import pytest

from mealgrid.sources.json_parts import array_items

FIELDS = "`name` string, `more` string"
TRICKY = [
    {"name": 'a } "quoted" { ] [', "more": {"deep": [{"x": "}"}, []]}},
    {"name": "back\\slash\\", "more": "\\\" }"},
    {"more": [1, 2, {"y": {}}], "name": "é日 }"},
    {},
    {"name": None, "more": "x" * 300},
    {"name": "tab\tnew\nline", "more": 5},
]


def write(folder, name, text):
    (folder / f"{name}.json").write_text(text, encoding="utf-8")


def read(spark, folder):
    rows = array_items(spark, str(folder), FIELDS).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["file_name"], r["item_no"])):
        out.setdefault(r["file_name"].removesuffix(".json"), []).append((r["item_no"], r["row"]["name"], r["row"]["more"]))
    return out


def wanted(items):
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    return [(k, text(i.get("name")), text(i.get("more"))) for k, i in enumerate(items)]


@pytest.mark.parametrize("size,times", [("40b", 1), ("3k", 12), ("128m", 12)])
def test_parts_of_any_size(spark, tmp_path, size, times):
    many = TRICKY * times
    write(tmp_path, "plain", json.dumps(many, ensure_ascii=False))
    write(tmp_path, "indented", json.dumps(many, indent=3))
    write(tmp_path, "one", json.dumps([{"name": "only"}]) + "\n")
    write(tmp_path, "none", " [ ]\n")
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = read(spark, tmp_path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {"plain": wanted(many), "indented": wanted(many), "one": [(0, "only", None)]}


BAD = {
    "cut": '[{"name": "a"}, {"name": "b',
    "no_end": '[{"name": "a"}',
    "end_twice": '[{"name": "a"}]]',
    "brace_behind": '[{"name": "a"}]}',
    "text_behind": '[{"name": "a"}] x',
    "no_array": '{"name": "a"}',
    "no_comma": '[{"name": "a"} {"name": "b"}]',
    "two_commas": '[{"name": "a"},, {"name": "b"}]',
    "last_comma": '[{"name": "a"},]',
    "number": '[1, {"name": "a"}]',
    "broken_object": '[{"name": "a"}, {"name" "b"}]',
    "late_break": "[" + ", ".join(['{"name": "a"}'] * 50) + ', {"name": a b}]',
    "array_of_arrays": '[[{"name": "a"}]]',
    "nothing": "",
    "word": "null",
}


def test_broken_arrays_are_absent_as_a_whole(spark, tmp_path):
    for name, text in BAD.items():
        write(tmp_path, name, text)
    write(tmp_path, "good", '[{"name": "a"}]')
    assert read(spark, tmp_path) == {"good": [(0, "a", None)]}
    assert array_items(spark, str(tmp_path / "absent"), FIELDS).collect() == []


def test_one_array_is_many_tasks(spark, tmp_path):
    from mealgrid.sources.json_parts import fragments

    write(tmp_path, "big", json.dumps([{"name": "x" * 1000}] * 1000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert fragments(spark, str(tmp_path), "*.json").rdd.getNumPartitions() >= 10
        assert len(read(spark, tmp_path)["big"]) == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_files_are_no_python_groups(spark, tmp_path):
    """Files are put in order by expressions, and the first part of a file has one case."""
    from mealgrid.sources.json_parts import beginnings, fragments, summed

    for k in range(30):
        write(tmp_path, f"f{k}", json.dumps(TRICKY[: k % 6]))
    sums = summed(fragments(spark, str(tmp_path), "*.json"))
    assert [r["begins_inside"] for r in sums.collect()] == [False] * 30
    begun = beginnings(sums)
    assert "FlatMapGroups" not in begun._jdf.queryExecution().toString()
    rows = begun.collect()
    assert len(rows) == 30 and all(r["open"] and (r["part"], r["inside"], r["depth"], r["objects"]) == (0, False, 0, 0) for r in rows)


def test_fragments_are_walked_in_one_go():
    import random
    import re

    from mealgrid.sources.json_parts import walked

    string, rng = re.compile(r'"(?:[^"\\]|\\.)*"', re.S), random.Random(4)
    for _ in range(300):
        items = [{rng.choice(['a}', 'é"', "\\", '\\"{']): rng.choice(["}", "[", [1, "]"], {"b": "日}"}, '"'])} for _ in range(rng.randint(1, 6))]
        text = json.dumps(items, ensure_ascii=rng.random() < 0.5)
        begin = rng.choice([k for k, c in enumerate("}" + text) if c == "}"])
        inside = string.sub("", text[:begin]).count('"') == 1
        texts = text[begin:].split("}")
        state, deep, want = inside, 0, []
        for t in texts:
            bare = string.sub("", '"' + t if state else t)
            quote = bare.find('"')
            outer = bare if quote < 0 else bare[:quote]
            state = quote >= 0
            deep += outer.count("{") + outer.count("[") - outer.count("]") - (not state)
            want.append((state, deep))
        blob, ends, within, depth = walked(texts, inside)
        assert list(zip(within.tolist(), depth.tolist())) == want
        assert blob.decode() == text[begin:] + "}" and [blob[e] for e in ends] == [ord("}")] * len(texts)
