import json

from pyspark.sql import functions as F

from sifter.functions import payload as PL


def test_repositories(spark):
    payload = json.dumps({"total_count": 7, "items": [
        {"full_name": "o/r", "description": None, "stargazers_count": 3, "forks_count": 1,
         "updated_at": "2024-01-02T03:04:05Z"},
        {"name": "plain"}]})
    df = spark.createDataFrame([(1, payload), (2, json.dumps({"total_count": 0}))], "id int, j string")
    rows = PL.flatten_repositories(df, "j", ["id"]).orderBy("id", "item_no").collect()
    assert rows[0]["name"] == "o/r" and rows[0]["description"] == "No description"
    assert rows[0]["has_details"] and rows[0]["updated"] == "2024-01-02"
    assert rows[1]["name"] == "plain" and not rows[1]["has_details"] and rows[1]["updated"] == "N/A"
    assert rows[2]["id"] == 2 and rows[2]["total_count"] == 0 and rows[2]["name"] == "Unknown"


def test_pull_request_status(spark):
    prs = [{"state": "open"}, {"state": "open", "draft": True}, {"state": "closed", "merged": True},
           {"state": "closed"}, {"state": "weird"}]
    df = spark.createDataFrame([(1, json.dumps(prs))], "id int, j string")
    out = [r["status"] for r in PL.flatten_pull_requests(df, "j", ["id"]).orderBy("item_no").collect()]
    assert out == ["open", "draft", "merged", "closed", "unknown"]


def test_issue_defaults(spark):
    df = spark.createDataFrame([(1, json.dumps([{"number": 5}]))], "id int, j string")
    r = PL.flatten_issues(df, "j", ["id"]).first()
    assert (r["title"], r["user"], r["state"], r["created"], r["is_open"]) == \
        ("No title", "unknown", "unknown", "N/A", False)


def test_json_or_text_and_summaries(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("not json",)], "t string")
    r = df.select(PL.json_or_text("t", "k int").alias("x")).collect()
    assert r[0]["x"]["parsed"]["k"] == 1 and r[1]["x"]["text"] == "not json"
    big = json.dumps({"a": 1, "b": True, "c": None, "d": {"x": "y" * 60}})
    s = spark.createDataFrame([(big,), ('{"a": 1, "b": "x"}',)], "t string").select(
        PL.summarise_json_object("t")).collect()
    assert s[0][0] == "• a: 1\n• b: True\n• c: None\n• d: [complex data]"
    assert s[1][0] == "a: 1 | b: x"
    arr = spark.createDataFrame([("[1,2,3,4,5,6]",)], "t string").select(PL.summarise_json_array("t"))
    assert arr.first()[0] == "[6 items: 1, 2, 3, ...]"


def test_summaries_know_json_types(spark):
    rows = [('{"a": "true", "b": true, "c": null}', "a: true | b: True | c: None"),
            ('["null", null, false, 1.50, "x"]', "null, None, False, 1.5, x"), ('"plain"', "plain"), ("true", "True"),
            ("12", "12"), ("null", "None"), ('{"a": 1, "b": "[x]", "c": 2, "d": [1, 2]}', "• a: 1\n• b: [x]\n• c: 2\n• d: [1,2]"),
            ("no json", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [(r.t, r.got) for r in df.select("t", PL.summarise_json("t").alias("got")).collect()] == rows


def test_payloads_of_another_type_fall_back(spark):
    payloads = ["not json", '{"title":"x"}', "[1, 2]", None, '"text"', "z" * 600]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, j string")
    raw = {0: "Raw content: not json...", 3: "Raw content: ...", 4: "text", 5: "Raw content: " + "z" * 500 + "..."}
    for flatten in (PL.flatten_issues, PL.flatten_pull_requests):
        got = {r.id: r for r in flatten(df.where("id <> 2"), "j", ["id"]).collect()}
        assert {i: r.fallback for i, r in got.items()} == {**raw, 1: "title: x"}
        assert all(r.item_no is None and r.title is None for r in got.values())
    got = {r.id: r.fallback for r in PL.flatten_repositories(df, "j", ["id"]).collect()}
    assert got == {**raw, 1: "title: x", 2: "1, 2"}
    got = {r.id: r.c for r in df.select("id", PL.created_item("j").alias("c")).collect()}
    assert got[1].title == "x" and got[1].fallback is None and got[2].fallback == "1, 2" and got[0].title is None
    got = {r.id: r.f for r in df.select("id", PL.file_contents("j").alias("f")).collect()}
    assert {i: f.fallback for i, f in got.items()} == {**raw, 1: "title: x", 2: "1, 2"}
    mixed = spark.createDataFrame([(1, '[{"title": "a"}]'), (2, "oops")], "id int, j string")
    assert {(r.id, r.title) for r in PL.flatten_issues(mixed, "j", ["id"]).collect()} == {(1, "a"), (2, None)}
