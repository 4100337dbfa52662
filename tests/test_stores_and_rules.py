"""Versioned tree, store addresses, robots files, schedules, JSON rules, trailers."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lexstrata.functions import json_rules, schedule, text
from lexstrata.sources import content_store, robots
from lexstrata.sources.tree import Conflict, Tree, safe_path


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def state(tree, ref=None):
    return {r.path: r.content for r in tree.at(ref).collect()}


def test_tree_keeps_every_state(spark, tmp_path):
    tree = Tree(spark, str(tmp_path / "tree"))
    assert tree.head() == 0 and state(tree) == {} and tree.read("a") is None
    assert tree.commit(files(spark, ("/a/x.md", "1"), ("a/y.md", "2"), ("b.md", "3"), ("b.md", "0")), "one") == 1
    assert tree.commit(files(spark, ("a/x.md", "1"), ("zz", None)), "same") is None and tree.head() == 1
    assert tree.commit(files(spark, ("a/x.md", None), ("a/y.md", "22"), ("c d.md", "")), "two") == 2
    assert tree.move_directory("/a/", "_repealed/a", "three") == 3
    states = {1: {"a/x.md": "1", "a/y.md": "2", "b.md": "3"}, 2: {"a/y.md": "22", "b.md": "3", "c d.md": ""}, 3: {"_repealed/a/y.md": "22", "b.md": "3", "c d.md": ""}}
    assert {r: state(tree, r) for r in states} == states and state(tree, 9) == states[3] and state(tree, 0) == {}
    tree.compact(2)
    tree.compact(2)
    again = Tree(spark, str(tmp_path / "tree"))
    assert {r: state(again, r) for r in states} == states and again.head() == 3
    assert {r.path: r["commit"] for r in again.at(3).collect()} == {"_repealed/a/y.md": 3, "b.md": 1, "c d.md": 2}
    assert again.read("/a/x.md", 1) == "1" and again.read("a/x.md") is None and again.exists("b.md") and not again.exists("b.md", 0)
    assert again.directory_exists("a", 2) and not again.directory_exists("a", 3) and not again.directory_exists("b.md")
    assert [r.path for r in again.list_files(ref=1).collect()] == ["a/x.md", "a/y.md", "b.md"] and [r.path for r in again.list_files("a/", 1).collect()] == ["a/x.md", "a/y.md"]
    found = again.found(spark.createDataFrame([("/b.md", 1), ("no", 2)], "path string, n int")).collect()
    assert {(r.n, r.content) for r in found} == {(1, "3"), (2, None)}
    assert [(r.number, r.message) for r in again.log(2).collect()] == [(3, "three"), (2, "two")] and again.log(0).count() == 0


def test_tree_refuses_a_second_writer_and_paths_outside(spark, tmp_path):
    one, two = Tree(spark, str(tmp_path / "tree")), Tree(spark, str(tmp_path / "tree"))
    one.commit(files(spark, ("a", "1")), "first")
    parent = two.head()
    two.head = lambda: parent  # it looked before the other wrote
    assert one.commit(files(spark, ("a", "2")), "mine", parent) == 2
    with pytest.raises(Conflict):
        two.commit(files(spark, ("a", "3")), "theirs", parent)
    with pytest.raises(Conflict):
        one.commit(files(spark, ("a", "3")), "late", 1)
    assert state(one) == {"a": "2"} and one.head() == 2
    for path in ("../x", "a/../../x", "", "/", " "):
        with pytest.raises(ValueError):
            safe_path(path)
        with pytest.raises(Exception, match="not a path inside"):
            one.commit(files(spark, (path, "x")), "bad")
    with pytest.raises(Exception, match="not a path inside"):
        one.commit(files(spark, (None, "x")), "bad")
    assert one.head() == 2


def test_addresses(spark):
    cases = [
        (b"PK\x03\x04x", "text/html", "zip"), (b"%PDF-1", None, "pdf"), (b"<a/>", "application/xhtml+xml; json", "xml"), (b"{}", "application/json", "json"), (b"<p>", "text/html", "html"),
        (b"x", "application/pdf", "pdf"), (b"x", "application/zip", "zip"), (b"<xml", "text/plain", "bin"), (b"\xff", None, "bin"),
    ]
    rows = spark.createDataFrame([(bytearray(c), t) for c, t, _ in cases], "c binary, t string")
    assert [r[0] for r in rows.select(content_store.extension(F.col("c"), F.coalesce("t", F.lit("")))).collect()] == [e for *_, e in cases]
    named = spark.createDataFrame([("--a b/ü--",), ("x.y_z-1",), (None,)], "s string")
    assert [r[0] for r in named.select(content_store.safe_name(F.col("s"))).collect()] == ["a-b", "x.y_z-1", "unknown"]
    empty = spark.createDataFrame([("",), (None,)], "c string").select(content_store.address(F.lit("s"), F.lit("2024-02-03").cast("date"), F.col("c"))).collect()
    assert [r[0] for r in empty] == [None, None]


def rules_of(spark, body, agent="Bot/1.2 (+x)"):
    rows = robots.parse_robots(spark.createDataFrame([("h", body)], "host string, t string"), "t", agent).collect()
    return sorted((r.field, r.value) for r in rows)


def test_robots_files(spark):
    cases = {
        "User-agent: *\nDisallow:\n": [], "User-agent: *\nDisallow: /": [("disallow", "/")], "": [], None: [],
        "# x\nUSER-AGENT: * # all\r\nDisallow: /a # b\rAllow: /\nno colon\nDisallow : /c\n": [("disallow", "/a"), ("disallow", "/c")],
        "User-agent: *\nDisallow: /x\nUser-agent: BOT\nDisallow: /own\nCrawl-delay: 2.5\nCrawl-delay: soon": [("crawl-delay", "2.5"), ("disallow", "/own")],
        "User-agent: bot\nUser-agent: other\nDisallow: /o\nUser-agent: *\nDisallow: /all": [],
        "User-agent: other\nUser-agent: bot\nDisallow: /o": [("disallow", "/o")],
        "User-agent: bot\nDisallow: /1\nUser-agent: x\nDisallow: /2\nUser-agent: bot\nDisallow: /3": [("disallow", "/1"), ("disallow", "/3")],
        "User-agent: bottle\nDisallow: /b\nUser-agent: *\nDisallow: /s": [("disallow", "/s")], "Disallow: /early\nUser-agent: *\nDisallow: /late": [("disallow", "/late")],
    }
    assert {k: rules_of(spark, k) for k in cases} == cases


def test_each_host_has_its_own_rules(spark):
    rules = spark.createDataFrame([("h1", "disallow", "/a"), ("h2", "disallow", "/b"), ("h2", "crawl-delay", "3"), (None, "disallow", "/")], "host string, field string, value string")
    rows = spark.createDataFrame([("h1", "/b/x"), ("h1", "/a/x"), ("h1", "/A"), ("h2", "/a/x"), ("h2", "/bc"), ("h3", "/a"), (None, "/a"), ("h1", None), ("h1", ""), ("h1", "/a/x")], "host string, path string")
    got = robots.allowed(rows, rules, "path", ("host",)).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in rows.collect() if (r.host, r.path) not in (("h1", "/a/x"), ("h2", "/bc")))
    assert robots.allowed(rows.select("path").distinct(), rules.drop("host").filter("value <> '/'"), "path").filter("path is not null").count() == 2


BERLIN = "Europe/Berlin"


def brute(line, zone, start, end):
    """Every minute of a range, in its local time; a repeated local minute counts once."""
    minutes, hours, days, months, week, either = schedule.compiled(line)
    at, out, seen, where = start, [], set(), ZoneInfo(zone)
    while at < end:
        here = at.astimezone(where)
        day, wd = days >> here.day & 1, week >> (here.isoweekday() % 7) & 1
        fits = (day or wd) if either else (day and wd)
        local = here.replace(tzinfo=None)
        if fits and minutes >> here.minute & 1 and hours >> here.hour & 1 and months >> here.month & 1 and local not in seen:
            out.append(at)
        seen.add(local)
        at += dt.timedelta(minutes=1)
    return out


@pytest.mark.parametrize("line", ["0 3 * * *", "30 2 * * *", "*/20 1-3 * * *", "15 2 25-31 3,10 0", "0 0 1 * 1", "5 2 * mar,oct sun", "@hourly"])
def test_next_runs_of_two_years_minute_by_minute(line):
    start, end = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2028, 1, 1, tzinfo=dt.timezone.utc)
    if line == "@hourly":
        start, end = dt.datetime(2026, 10, 20, tzinfo=dt.timezone.utc), dt.datetime(2026, 11, 1, tzinfo=dt.timezone.utc)
    expected, got, at = brute(line, BERLIN, start, end), [], start - dt.timedelta(minutes=1)
    while (at := schedule.next_run(line, BERLIN, at)) is not None and at < end:
        got.append(at)
    assert got == expected
    rng = random.Random(line)
    for _ in range(60):
        since, until = sorted(start + dt.timedelta(minutes=rng.randrange(int((end - start).total_seconds() // 60))) for _ in range(2))
        assert schedule.last_run(line, BERLIN, until, since) == max((x for x in expected if since < x <= until), default=None)


def test_odd_lines(spark):
    utc = dt.timezone.utc
    assert schedule.next_run("0 12 29 2 *", "UTC", dt.datetime(2026, 1, 1, tzinfo=utc)) == dt.datetime(2028, 2, 29, 12, tzinfo=utc)
    assert schedule.next_run("0 0 30 2 *", "UTC", dt.datetime(2026, 1, 1, tzinfo=utc)) is None
    assert schedule.compiled("0 0 * * 7") == schedule.compiled("0 0 * * 0") and schedule.compiled("@daily") == schedule.compiled("0 0 * * *")
    rows = spark.createDataFrame([("0 3 * * *", BERLIN, 0.0), ("bad", BERLIN, 0.0), ("61 * * * *", BERLIN, 0.0), ("0 3 * * *", "No/Where", 0.0), (None, BERLIN, 0.0), ("0 3 * * *", BERLIN, None), ("0 0 30 2 *", "UTC", 0.0)], "l string, z string, t double")
    assert [r[0] for r in rows.select(schedule.next_runs(F.col("l"), F.col("z"), F.col("t"))).collect()] == [7200, None, None, None, None, None, None]
    due = rows.select(schedule.due_runs(F.col("l"), F.col("z"), F.col("t"), F.lit(3 * 86400.0))).collect()
    assert [r[0] for r in due] == [2 * 86400 + 7200, None, None, None, None, None, None]


def errors_of(spark, schema, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in rows.select("i", json_rules.schema_errors(F.try_parse_json("t"), schema)).orderBy("i").collect()]


def test_json_messages(spark):
    assert errors_of(spark, {"const": 1}, "1", "1.0", '"1"', "null") == [[], ["$ must be 1."], ["$ must be 1."], ["$ must be 1."]]
    assert errors_of(spark, {"enum": ["a/b", None, 2]}, '"a/b"', "null", "2", "3") == [[], [], [], ['$ must be one of "a\\/b", null, 2.']]
    assert errors_of(spark, {"type": "string", "minLength": 3, "pattern": "^x"}, "5", '"y"', '"xyz"') == [["$ must be of type string, integer given."], ["$ must be at least 3 characters long.", "$ must match the pattern ^x."], []]
    assert errors_of(spark, {"const": 3, "type": "string"}, "4") == [["$ must be 3.", "$ must be of type string, integer given."]]
    assert errors_of(spark, {"type": ["number", "null"], "minimum": 1, "maximum": 2.5}, "0", "1.5", "3", "null", "true") == [["$ must be at least 1."], [], ["$ must be at most 2.5."], [], ["$ must be of type number|null, boolean given."]]
    assert errors_of(spark, {"format": "date"}, '"2024-01-02"', '"x"', "7") == [[], ["$ must be a date in YYYY-MM-DD form."], []]
    shape = {"type": "object", "required": ["b", "a"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"type": "string", "maxLength": 1}}}
    assert errors_of(spark, shape, '{"z": 1, "b": "xx"}', "{}", "[]", "[1]") == [
        ['$ is missing the required property "a".', '$ has the unexpected property "z".', "$.b must be at most 1 characters long."],
        ['$ is missing the required property "b".', '$ is missing the required property "a".'], ['$ is missing the required property "b".', '$ is missing the required property "a".'], ["$ must be of type object, array given."],
    ]
    assert errors_of(spark, {"additionalProperties": False}, '{"z": 1}') == [[]]
    assert errors_of(spark, {"minItems": 2, "maxItems": 2, "items": {"type": "integer"}}, '[1, "x", null]', "[]", "{}") == [
        ["$ must have at most 2 items.", "$[1] must be of type integer, string given.", "$[2] must be of type integer, null given."], ["$ must have at least 2 items."], ["$ must have at least 2 items."],
    ]
    assert errors_of(spark, {"allOf": [{"type": "integer"}, {"minimum": 5}], "anyOf": [{"const": 1}, {"const": 7}]}, "7", "1", '"x"') == [
        [], ["$ must be at least 5."], ["$ must be of type integer, string given.", "$ does not match any of the allowed shapes (anyOf)."],
    ]
    many = errors_of(spark, {"items": {"type": "string"}}, "[" + ", ".join(map(str, range(30))) + "]")[0]
    assert len(many) == 20 and many[-1] == "$[19] must be of type string, integer given."


def test_schema_registry(spark):
    registry = {("t", 1): {"type": "integer"}, ("t", 3): {"type": "string"}, ("u", 1): {}}
    rows = spark.createDataFrame([(0, "5", "t", 1), (1, "5", "t", 3), (2, "5", "t", None), (3, "5", "t", 2), (4, "5", "x", None), (5, "5", None, 1), (6, "5", "u", 1)], "i int, v string, n string, k int")
    got = [r.e for r in rows.select("i", json_rules.registry_errors(F.try_parse_json("v"), F.col("n"), F.col("k"), registry).alias("e")).orderBy("i").collect()]
    wrong = ["$ must be of type string, integer given."]
    assert got == [[], wrong, wrong, ["There is no schema t 2."], ["There is no schema x ?."], ["There is no schema null 1."], []]
    assert [json_rules.schema_version(s) for s in ({}, {"version": 3}, {"version": "4"}, {"version": "x"}, {"version": 2.0})] == [1, 3, 4, 1, 2]


def test_trailers_and_markers(spark):
    rows = spark.createDataFrame([("m \n\n", ["X: 1", "Change-Id: c", "Source: s", "X: 1"]), ("m", []), ("m\n", ["Amending-Act: a", "Source-Url: u"])], "m string, t array<string>")
    assert [r[0] for r in rows.select(text.with_trailers(F.col("m"), F.col("t"))).collect()] == ["m\n\nSource: s\nChange-Id: c\nX: 1\n", "m\n", "m\n\nSource-Url: u\nAmending-Act: a\n"]
    lines = spark.createDataFrame([("a < b | c",), ("| d",), (" + e",), ("~f",), ("`g`",), ("3) h",), ("1.5 i",)], "t string")
    assert [r[0] for r in lines.select(text.escape_line(F.col("t"))).collect()] == ["a \\< b | c", "\\| d", " \\+ e", "\\~f", "\\`g\\`", "3\\) h", "1.5 i"]
    assert [r[0] for r in lines.select(text.unescape_markdown(text.escape_inline(F.col("t")))).collect()] == [r.t for r in lines.collect()]
    marks = spark.createDataFrame([(" 3. ",), ("bb)",), ("§ 1",), ("*",)], "t string")
    assert [r[0] for r in marks.select(text.escape_list_marker(F.col("t"))).collect()] == ["3\\.", "bb\\)", "§ 1", "\\*"]


def test_abbreviations_with_and_without_spaces(spark):
    from lexstrata.operators.sentences import sentences

    cases = {
        "Das gilt z.B. Kinder und d.h. Alle.": ["Das gilt z.B. Kinder und d.h. Alle."], "Es gilt i.V.m. Absatz 2. Danach nicht.": ["Es gilt i.V.m. Absatz 2.", "Danach nicht."],
        "Siehe (u.a. Seite 3) und i. d.R. Fälle. Ende.": ["Siehe (u.a. Seite 3) und i. d.R. Fälle.", "Ende."], "Das ist xd.h. Nein.": ["Das ist xd.h.", "Nein."], "Nach v.H. Sätzen o.Ä. Dingen.": ["Nach v.H. Sätzen o.Ä. Dingen."],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_states_without_contents_move_hashes_only(spark, tmp_path, capsys):
    tree = Tree(spark, str(tmp_path / "tree"))
    tree.commit(spark.createDataFrame([("a/b", "x"), ("c", "y")], "path string, content string"), "one")
    tree.commit(spark.createDataFrame([("a/b", None), ("c", "z")], "path string, content string"), "two")
    bare = tree.at(2, content=False)
    assert bare.collect() == tree.at(2).drop("content").collect() and [r.path for r in bare.collect()] == ["c"]
    bare.explain("formatted")
    assert "content_hash" in (plan := capsys.readouterr().out) and "content#" not in plan
