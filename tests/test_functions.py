"""Table-driven cases for text, date, document and JSON functions, and streams."""

import datetime
import hmac
import re

import pytest
from pyspark.sql import functions as F

from lexstrata.functions import dates, json_rules, money, text
from lexstrata.functions.language import detect_language
from lexstrata.functions.signing import hmac_sha256_hex
from lexstrata.operators import audience, card_checks, cards, documents, quality, queueing, sentences, snapshots, versions


def values(spark, expr, rows, columns="a string"):
    """The expression's value for each row, in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "n int, " + columns)
    return [r.v for r in df.select("n", expr.alias("v")).orderBy("n").collect()]


@pytest.mark.parametrize(
    ("paragraph", "expected"),
    [
        ("", []),
        ("Ein Satz. Noch einer! Und wer? Niemand", ["Ein Satz.", "Noch einer!", "Und wer?", "Niemand"]),
        ("Nach Abs. 2 und z. B. Nr. 4 gilt es. Ende.", ["Nach Abs. 2 und z. B. Nr. 4 gilt es.", "Ende."]),
        ("Am 1. Januar 2026 tritt es in Kraft. Der 3. Teil bleibt.", ["Am 1. Januar 2026 tritt es in Kraft.", "Der 3. Teil bleibt."]),
        ("Es gilt Absatz 3. Die Frist läuft.", ["Es gilt Absatz 3.", "Die Frist läuft."]),
        ("Es gilt Absatz 3. Satz 2 bleibt.", ["Es gilt Absatz 3. Satz 2 bleibt."]),
        ("Ein Wort (dies. Das! Ja?) bleibt ganz. So.", ["Ein Wort (dies. Das! Ja?) bleibt ganz.", "So."]),
        ("Wert 3.5 bleibt. §  4 beginnt  neu.", ["Wert 3.5 bleibt.", "§ 4 beginnt neu."]),
        ("Ende. klein geschrieben.", ["Ende. klein geschrieben."]),
        ("Zu viel) hier. Weiter (so. Und ) fort. Neu (a. B", ["Zu viel) hier.", "Weiter (so. Und ) fort.", "Neu (a. B"]),
        ("! Ja ? Nein", ["!", "Ja ?", "Nein"]),
    ],
)
def test_sentences(spark, paragraph, expected):
    df = spark.createDataFrame([(1, paragraph)], "k int, t string")
    rows = sentences.split_sentences(df, ["k"], "t").orderBy("sentence_no").collect()
    assert [r.sentence for r in rows] == expected


def test_norm_keys(spark):
    rows = [("§ 18g", "x"), ("§§ 5 bis 7", "x"), ("Artikel 3", "x"), ("Anlage 2b", "x"), ("Anhang", "x"), ("Schlußformel Ä", "x"), (None, "BJNR1"), (" ", None)]
    got = values(spark, text.norm_key(F.col("a"), F.col("b")), rows, "a string, b string")
    assert got == ["p18g", "p5-7", "art3", "anl2b", "anl", "schlussformel-ae", "n-bjnr1", "n-unknown"]


def test_unique_keys(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(["p1", "p1", "p1-2", "p1", "p2"])], "law int, place int, base string")
    got = documents.unique_keys(rows, ["law"], "base", "place").orderBy("place").collect()
    assert [r.unique_key for r in got] == ["p1", "p1-2", "p1-2-2", "p1-3", "p2"]


def test_citations(spark):
    notes = ["siehe Art. 4 Abs. 9 G v. 5.6.2031 I Nr. 88", "dazu Bek. v. 1.2.2003 II 345", "V v. 3.4.2020 I Nr. 7", "ohne", None]
    c = text.citation(F.col("a"))
    assert values(spark, text.change_id(c), notes) == ["2031-bund-bgbl-i-88", "2003-bund-bgbl-ii-s345", "2020-bund-bgbl-i-7", None, None]
    assert values(spark, text.citation_label(c), notes) == ["BGBl. 2031 I Nr. 88", "BGBl. II 2003, 345", "BGBl. 2020 I Nr. 7", None, None]
    assert values(spark, text.article_label(c), notes) == ["Art. 4 Abs. 9", None, None, None, None]
    more = ["Art. 3 a G v. 12. 8.2031 I Nr. 61 und G v. 1.1.2020 II 5", "Art. 7b VO v. 2.3.2021 II 17", "Abs. 2 G v. 2.3.2021 I 17", "Bek v. 1.2.2003 II 345", "XG v. 1.2.2003 II 345", "G v. 1.2.03 II 345", "G v. 1.2.2003 III 345"]
    assert values(spark, text.article_label(c), more) == ["Art. 3a", "Art. 7b", None, None, None, None, None]
    assert values(spark, text.change_id(c), more) == ["2031-bund-bgbl-i-61", "2021-bund-bgbl-ii-s17", "2021-bund-bgbl-i-s17", None, None, None, None]


def test_effective_dates(spark):
    d = datetime.date
    cases = [
        ("Am Tag nach der Verkündung", d(2026, 1, 31), d(2026, 2, 1)), ("am Tage der Verkündung", d(2026, 1, 31), d(2026, 1, 31)),
        ("am ersten Tag des vierten auf die Verkündung folgenden Kalendermonats", d(2026, 1, 31), d(2026, 5, 1)), ("am ersten Tag des folgenden Monats", d(2026, 12, 31), d(2027, 1, 1)),
        ("einen Monat nach der Verkündung", d(2026, 1, 31), d(2026, 3, 3)), ("14 Tage nach der Verkündung", d(2026, 2, 20), d(2026, 3, 6)), ("am 1. März 2027", d(2026, 1, 1), d(2027, 3, 1)),
        ("ab 05.06.2027", d(2026, 1, 1), d(2027, 6, 5)), ("am 30. Februar 2027", d(2026, 1, 1), None), ("irgendwann", d(2026, 1, 1), None), (None, d(2026, 1, 1), None), ("", d(2026, 1, 1), None),
        ("Dieses Gesetz tritt am ersten Tag des auf die Verkündung folgenden Kalendermonats in Kraft.", d(2026, 1, 31), d(2026, 2, 1)), ("tritt zwölf Monate nach der Verkündung in Kraft", d(2026, 1, 1), d(2027, 1, 1)),
        ("am ersten Tag des xten auf die Verkündung folgenden Kalendermonats", d(2026, 1, 1), None), ("viele Tage nach der Verkündung", d(2026, 1, 1), None), ("drei Tagen nach der Verkündung", d(2026, 1, 1), d(2026, 1, 4)),
        ("gilt ab 1.Januar 2027", d(2026, 1, 1), d(2027, 1, 1)), ("im Jahr 2027 am Tag nach der Verkündung", d(2026, 1, 1), d(2026, 1, 2)), ("(31. Juni 2026) am Tage der Verkündung", d(2026, 1, 1), d(2026, 1, 1)),
    ]
    got = values(spark, dates.effective_date(F.col("a"), F.col("b")), [(a, b) for a, b, _ in cases], "a string, b date")
    assert got == [c[2] for c in cases]
    assert values(spark, dates.plus_months(F.col("a"), F.lit(1), overflow=False), [d(2026, 1, 31)], "a date") == [d(2026, 2, 28)]


def test_numbers_and_values(spark):
    assert values(spark, text.grouped_numbers_joined(F.col("a")), ["Von 7.250 Mark", "3 141 592 plus 12.5", "4.5.1999", "9.876.543.210.987.654.321 x 1.234", "12.3456 1234.567"]) == ["von 7250 mark", "3141592 plus 12.5", "4.5.1999", "9876543210987654321 x 1234", "12.3456 1234.567"]
    mixed = ["1.234.5678 x", "preis 61 200 14 tage", "5 300 4", "abc12.345", "61.200x", "(61.200)", "61.200,5", "7.250 8 100", "0.123.456.7", "x 1.000 1.000"]
    assert values(spark, text.grouped_numbers_joined(F.col("a")), mixed) == ["1234.5678 x", "preis 61200 14 tage", "5300 4", "abc12.345", "61.200x", "(61200)", "61200,5", "7250 8100", "0123456.7", "x 1000 1000"]
    assert values(spark, text.bare_values(F.col("a")), ["7.250 und 8 % am 3. 4. 2031, {{amount:a}} 2031-05-06", "nichts"]) == [["7.250", "8 %", "3. 4. 2031", "2031-05-06"], []]
    found = [("Gezahlt werden 61.250 Euro im Jahr.", "61.250"), ("Gezahlt werden 61 250 Euro im Jahr.", "61 250"), ("macht 75 € je Stück", "75 €"), ("ein Abschlag von 12 Prozent", "12 Prozent"), ("Frist: 30.11.2031!", "30.11.2031"), ("Frist: 2031-11-30!", "2031-11-30"), ("1.234,56 EUR", "1.234,56")]
    got = values(spark, text.bare_values(F.col("a")), [x for x, _ in found])
    assert all(literal in g for (_, literal), g in zip(found, got))
    clean = ["Im Jahr 2031 lief alles.", "Vgl. § 77c Nummer 4", "Dafür gibt es 6 Gründe", "Am {{ date:start.1 }} fließen {{ amount:b.old }}"]
    assert values(spark, text.bare_values(F.col("a")), clean) == [[]] * 4
    got = values(spark, quality.value_in_quote(F.col("a"), F.col("b")), [("um 48 Euro", 48.0), ("um 4830", 48.0), ("2,5 %", 2.5), ("3 %", 2.5), ("nichts", 7.0)], "a string, b double")
    assert got == [True, True, True, True, False]


def test_placeholders(spark):
    assert values(spark, text.placeholders(F.col("a")), ["{{ amount : a.b }} {{date:x}} {{amount:a.b}} {{Bad:x}}"]) == [["{{amount:a.b}}", "{{date:x}}", "{{amount:a.b}}"]]


def test_language(spark):
    ru, uk = "что если это нужно также для вас сделать прямо сейчас этот закон", "що якщо це потрібно також для вас зробити просто зараз цей закон"
    tr, en, de = "bu yasa ile ilgili değişiklik olan herkes için geçerli bir kural", "the law that applies to you and the people from this country", "das gesetz gilt nicht für alle und wird von der behörde geprüft"
    assert values(spark, detect_language(F.col("a")), [ru, uk, tr, en, de, "kurz", None]) == ["ru", "uk", "tr", "en", "de", None, None]


def test_encoding(spark):
    got = values(spark, text.encoding_issues(F.col("a")), [b"ok\n", b"\xff\x07", b"a\x07", "﻿a\x1f".encode(), None], "a binary")
    assert got == [[], ["invalid_encoding"], ["control_characters"], ["control_characters", "byte_order_mark"], []]


def test_escape(spark):
    assert values(spark, text.escape_line(F.col("a")), ["a*b_[c]", "# x", "  - y", "12. z", "1) ", "1.5"]) == ["a\\*b\\_\\[c\\]", "\\# x", "  \\- y", "12\\. z", "1\\) ", "1.5"]


def test_hmac(spark):
    expected = hmac.new(b"k" * 70, b"body", "sha256").hexdigest()
    assert values(spark, hmac_sha256_hex(F.col("a"), "k" * 70), ["body"]) == [expected]


def test_cost_and_budget(spark):
    d = lambda c: F.lit(c).cast("decimal(10,4)")
    cost = money.usage_cost(F.col("a"), F.lit(100), F.lit(400), d("3"), d("15"), F.lit(None).cast("decimal(10,4)"), d("0.9"))
    assert [str(x) for x in values(spark, cost, [1000, 0], "a long")] == ["0.004050", "0.002430"]
    assert values(spark, money.budget_state(F.col("a"), F.lit(10.0)), [1.0, 8.0, 10.0], "a double") == ["ok", "warning", "exceeded"]


def test_json_rules(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 1, "items": {"type": ["integer", "null"], "minimum": 0}}, "b": {"enum": ["x", 1]}, "c": {"oneOf": [{"type": "string"}, {"type": "boolean"}]}}, "additionalProperties": False}
    texts = ['{"a": [1, null, 2.0]}', 'so: {"a": [-1, "x"], "b": "y"}', '```json\n{"a": [], "c": 3, "z": 0}\n```', '{"b": 1}', "[1]"]
    got = values(spark, json_rules.schema_errors(json_rules.decoded(F.col("a")), schema), texts)
    assert got[0] == ["$.a[2] must be of type integer|null, number given."] and got[3] == ['$ is missing the required property "a".']
    assert got[1] == ["$.a[0] must be at least 0.", "$.a[1] must be of type integer|null, string given.", '$.b must be one of "x", 1.']
    assert got[2] == ['$ has the unexpected property "z".', "$.a must have at least 1 items.", "$.c does not match any of the allowed shapes (oneOf)."]
    assert values(spark, json_rules.decoded(F.col("a")).isNull(), texts) == [False, False, False, False, True]


def test_tables_and_lists(spark):
    got = values(spark, documents.render_table(F.col("a")), ["<table><tr><th>a|b</th><th>c</th></tr><tr><td>1</td><td>2</td></tr></table>", "<table><tr><td colspan='2'>x</td></tr></table>", "<table><tr><td>1</td></tr><tr><td>2</td><td>&lt;3</td></tr></table>", "<p>no</p>"])
    assert got == ["| a\\|b | c |\n| --- | --- |\n| 1 | 2 |", "<table>\n<tr><td colspan=\"2\">x</td></tr>\n</table>", "<table>\n<tr><td>1</td></tr>\n<tr><td>2</td><td>&lt;3</td></tr>\n</table>", ""]
    html = "<h1>T</h1><p>One <b>two</b> &amp; 3<sup>2</sup></p><h2>S</h2><ul><li>a<ul><li>b</li></ul><li>c</ul><p>end<script>x</script>"
    df = spark.createDataFrame([(1, html), (2, None)], "k int, h string")
    rows = documents.to_markdown(df, ["k"], "h").collect()
    assert [r.markdown for r in rows] == ["# T\n\nOne **two** & 3<sup>2</sup>\n\n## S\n\n- a\n  - b\n- c\n\nend\n"]
    nodes = documents.structure_nodes(df, ["k"], "h").orderBy("node").collect()
    assert [(r.title, r.depth, r.blocks) for r in nodes] == [("T", 1, 1), ("S", 2, 4)] and nodes[1].parent == nodes[0].node


def test_cards(spark):
    body = "intro\n## Was {#what}\n\nText A\n\n## Wer {#who}\nText B\n## Was {#what}\nneu\n"
    assert values(spark, cards.parse_card(F.col("a")), [body, "nichts"]) == [{"who": "Text B", "what": "neu"}, {}]
    assert values(spark, cards.front_matter(F.col("a")), ["---\na: 1\n---\nrest", "rest"]) == [("a: 1", "rest"), (None, "rest")]


def test_audience_truth_table(spark):
    cases = [  # tags, land, interests, answered, lands, general, all_of, any_of, none_of, topics, impact -> level
        ((["w.a"], "BE", [], ["w"], [], False, ["w.a"], [], [], [], 1), "direct"), ((["w.a"], "BE", [], [], [], False, ["w.a"], [], [], [], 1), "possible"),
        ((["w.a", "k.x"], "BE", [], ["w", "k"], [], False, ["w.a"], [], ["k.x"], [], 3), "other"), ((["w.b"], "BE", [], ["w"], [], False, [], ["w.a"], [], [], 1), "possible"),
        (([], "BE", ["tax"], [], [], False, [], [], [], ["tax"], 1), "possible"), (([], "BE", [], [], ["BY"], True, [], [], [], [], 3), None),
        (([], None, [], [], [], True, [], [], [], [], 2), "direct"), ((None, None, None, None, None, None, None, None, None, None, None), "other"),
    ]
    columns = "tags array<string>, land string, interests array<string>, answered array<string>, lands array<string>, general boolean, all_of array<string>, any_of array<string>, none_of array<string>, topics array<string>, impact int"
    level = audience.match_level(*[F.col(c.split()[0]) for c in columns.split(", ")])
    assert values(spark, level, [c for c, _ in cases], columns) == [e for _, e in cases]


def test_queue(spark):
    events = spark.createDataFrame([(1, "lease", 1), (1, "fail", 2), (1, "lease", 3), (2, "lease", 1), (2, "succeed", 2), (2, "lease", 3), (3, "lease", 1), (3, "fail", 2), (3, "lease", 3), (3, "fail", 4), (3, "lease", 5), (3, "fail", 6), (4, "cancel", 1)], "job long, kind string, t int")
    got = {r.job: (r.attempts, r.status) for r in queueing.fold_events(events, "job", "kind", "t").collect()}
    assert got == {1: (2, "leased"), 2: (1, "succeeded"), 3: (3, "failed"), 4: (0, "cancelled")}


def test_snapshots_rerun_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, t string")
    assert {r.outcome for r in snapshots.compare_snapshots(rows, rows.repartition(3), "k", "t").collect()} == {"unchanged"}
    grouped = versions.group_changes(spark.createDataFrame([("g", i, None if i < 2 else f"n{i}") for i in range(5)], "g string, m int, note string"), "g", "m", "note", "m").collect()
    assert [(r.members, r.note, r.title) for r in grouped] == [(5, "n2", "0, 1, 2 und 2 weitere")]


def test_streams_agree_with_batch(spark, tmp_path, sf_dir):
    from lexstrata.streaming import processors

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type").isin("view", "click"), "lease").when(F.col("event_type") == "error", "fail").otherwise("succeed")
    jobs = events.select((F.col("event_id") % 100).alias("job"), kind.alias("kind"), "ts", "event_id")
    jobs.coalesce(1).write.parquet(str(tmp_path / "jobs"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = {r.job: (r.attempts, r.status) for r in run(processors.lease_stream(source, "job", "kind", "ts", "event_id"), "leases", "update").collect()}
    assert got == {r.job: (r.attempts, r.status) for r in queueing.fold_events(jobs, "job", "kind", "ts", "event_id").collect()}
    found = {r.key: r.settling_started_at for r in run(processors.settling_stream(source, "job", "ts", 72), "settled", "append").collect()}
    now = F.lit(jobs.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR")
    expected = {r.job: r.settling_started_at for r in queueing.settled(jobs, "job", "ts", now, 72).collect()}
    assert set(found) <= set(expected) and all(abs((found[k] - expected[k]).total_seconds()) < 1 for k in found) and len(found) >= 0.9 * len(expected)
    once = run(processors.deliver_once(source, "job", "ts", "30 days"), "once", "append")
    assert once.count() == jobs.select("job").distinct().count()


def test_histories(spark, tmp_path):
    from lexstrata.sources import history

    log = "\x1f".join(["c1", "A", "a@x", "2024", "s1", "b1"]) + "\x1e\n" + "\x1f".join(["c2", "B", "b@x", "2025", "s2", ""]) + "\x1e"
    rows = history.parse_log(spark.createDataFrame([(1, log), (2, None)], "k int, t string"), ["k"], "t").orderBy("place").collect()
    assert [(r.commit, r.subject, r.body) for r in rows] == [("c1", "s1", "b1"), ("c2", "s2", "")]
    stats = history.parse_numstat(spark.createDataFrame([(1, "3\t1\ta.md\n-\t-\tb.png\nnoise")], "k int, t string"), ["k"], "t").collect()
    assert [(r.path, r.added, r.removed) for r in stats] == [("a.md", 3, 1), ("b.png", 0, 0)]
    one, two = "a" * 40, "b" * 40
    blame = f"{one} 1 1 2\nauthor Ann\nsummary x\n\tfirst\n{two} 1 2 1\nauthor Bob\n\tsecond\n{one} 2 3\n\tthird"
    got = history.parse_provenance(spark.createDataFrame([(1, blame)], "k int, t string"), ["k"], "t").orderBy("line_no").collect()
    assert [(r.line_no, r.author, r.content) for r in got] == [(1, "Ann", "first"), (2, "Bob", "second"), (3, "Ann", "third")]
    rows = spark.createDataFrame([("p1", "x"), ("p2", "y")], "path string, content string")
    path = str(tmp_path / "commits")
    first = history.append_commit(spark, path, rows, "m")
    assert first == history.append_commit(spark, path, rows.orderBy(F.desc("path")), "m") and history.append_commit(spark, path, rows.limit(0), "m") is None
    assert spark.read.parquet(path).count() == 4


def test_vocabulary_reading_forgives(spark, tmp_path):
    from lexstrata.sources.vocabulary import read_vocabulary

    (tmp_path / "v.jsonl").write_text('{"tag": "a", "group": "g"}\nbroken\n{"tag": "b"}\n{"tag": "a", "group": "g", "exclusive": true}\n')
    rows = read_vocabulary(spark, str(tmp_path / "v.jsonl"), "taxonomy").collect()
    assert [(r.tag, r.exclusive) for r in rows] == [("a", True)]


def test_content_store_writes_once(spark, tmp_path):
    from lexstrata.sources.content_store import store_new

    rows = spark.createDataFrame([("s", "2024-01-01", "x"), ("s", "2024-01-01", "x"), ("s", "2024-01-02", None), ("s", "2024-01-02", ""), ("t", "2024-01-02", "x")], "source string, day string, content string")
    path = str(tmp_path / "store")
    store_new(rows, path, "source", "day", "content")
    store_new(rows, path, "source", "day", "content")
    assert spark.read.parquet(path).count() == 2


def test_phrases_long_short_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 2)
    texts = {1: "the quick brown fox jumps", 2: "a quick brown dog", 3: "", 4: None, 5: "hot hot hot quick brown fox"}
    phrases = {"a": "uick brown fo", "b": "fox", "c": "hot hot", "d": "ick", "e": "", "f": None, "g": "k b", "h": "brown fox jumps high"}
    left = spark.createDataFrame(list(texts.items()), "k int, t string")
    right = spark.createDataFrame(list(phrases.items()), "p string, w string")
    expected = sorted((k, p) for k, t in texts.items() for p, w in phrases.items() if t is not None and w and w in t)
    assert sorted(tuple(r) for r in quality.phrase_matches(left, right, "t", "w", "k", "p").collect()) == expected
    assert quality.phrase_matches(left, right.limit(0), "t", "w", "k", "p").count() == 0


def test_merged_cells_keep_their_spans(spark):
    markup = '<table><tr><th colspan="2">a &amp; b</th><td ROWSPAN=12>c</td></tr><tr><td rowspan="1">1</td><td>2</td></tr></table>'
    assert values(spark, documents.render_table(F.col("a")), [markup]) == ['<table>\n<tr><td colspan="2">a &amp; b</td><td rowspan="12">c</td></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>']


def test_long_texts_do_not_exhaust_the_stack(spark):
    many = " ".join(["7"] * 60_000) + " 5 %"
    assert values(spark, text.bare_values(F.col("a")), [many]) == [["5 %"]]
    assert values(spark, text.grouped_numbers_joined(F.col("a")), ["1." + "234." * 30_000 + "567"]) == ["1" + "234" * 30_000 + "567"]
    one = "wort " * 60_000 + "ende."
    assert values(spark, F.size(sentences.sentences(F.col("a"))), [one, "Ja. " * 3000]) == [1, 3000]


def test_texts_are_not_gathered_by_a_list_or_a_language(spark, capsys):
    """A list of phrases goes to the texts: no exchange brings all texts of one block, word or language together."""
    texts = spark.range(40).selectExpr("id AS k", "concat('all people hold that word here ', id) AS t")
    phrases = spark.createDataFrame([("a", "that word"), ("b", "people hold that"), ("b", "people hold that"), ("c", "all people hold that word")], "p string, w string")
    found = quality.phrase_matches(texts, phrases, "t", "w", "k", "p")
    assert sorted(tuple(r) for r in found.groupBy("p").count().collect()) == [("a", 40), ("b", 80), ("c", 40)]
    cards = texts.selectExpr("k AS subject", "'en' AS lang", "map('summary', t) AS s")
    hits = card_checks.wording_hits(cards, "s", phrases.selectExpr("w AS phrase", "'en' AS lang"))
    assert hits.count() == 120
    found.explain()
    hits.explain()
    plan = capsys.readouterr().out
    gathered = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[(\w+)#\d+L?(?:, _salt#\d+)?\]", plan)
    assert "Exchange" in plan and set(gathered) <= {"k", "_row"}
