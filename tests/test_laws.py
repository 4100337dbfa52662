"""Law containers, the block automaton, the span grid, and the tables made of them."""

import io
import re
import tracemalloc
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import laws
from lexstrata.operators.law_markup import Norm, placed
from lexstrata.sources.containers import NormStream, law_stream, read_containers, write_containers

BASE = "https://src.example"


def norm_xml(content, meta="<enbez>§ 1</enbez>", notes=""):
    return f'<norm doknr="N1"><metadaten>{meta}</metadaten><textdaten><text><Content>{content}</Content></text>{notes}</textdaten></norm>'


def law_xml(*norms, header="<langue>Ein Gesetz</langue>"):
    return f'<dokumente doknr="LAW"><norm doknr="H"><metadaten>{header}</metadaten></norm>{"".join(norms)}</dokumente>'


@pytest.fixture(scope="module")
def body(spark):
    def of(*contents):
        rows = [(f"s{i:03}", "L", 1, norm_xml(c) if not c.startswith("<norm") else c, None) for i, c in enumerate(contents)]
        frame = spark.createDataFrame(rows, "slug string, document_id string, position int, xml string, error string")
        return [r.body for r in laws.bodies(laws.fold_norms(frame, BASE)).orderBy("slug").collect()]

    return of


def test_bodies(body):
    cases = {
        "<P>Erster Fall. Zweiter Fall.</P><P/>": "Erster Fall.\nZweiter Fall.",
        "<P>vor<DL><DT>7.</DT><DD><LA>sieben</LA></DD><DT>8.</DT><DD>acht</DD></DL>nach</P>": "vor\n\n- 7\\. sieben\n- 8\\. acht\n\nnach",
        "<DL><DT>1)</DT><DD>Satz eins. Satz zwei.</DD></DL>": "- 1\\) Satz eins.\n  Satz zwei.",
        "<DL><DD>ohne Zeichen</DD><DT>b)</DT><DD/></DL>": "- ohne Zeichen\n- b\\)",
        "<DL><DT>1.</DT><DD><LA>a <DL><DT>aa)</DT><DD><Revision>b <DL><DT>x.</DT><DD>c<DL><DT>y.</DT><DD>d</DD></DL></DD></DL></Revision></DD></DL> z</LA></DD></DL>":
            "- 1\\. a z\n  - aa\\) b\n    - x\\. c\n      - y\\. d",
        "<P>a<BR/>b <SUP>2</SUP> <QuoteL/>q<QuoteR/></P>": "a b \\<sup>2\\</sup> „ q “",
        '<P>x<FnR ID="Fn 9.1"/></P><Footnotes><Footnote ID="Fn 9.1">Anmerkung <B>fett</B></Footnote></Footnotes>': "x \\[^fn-9-1\\]\n\n## Fußnoten\n\n[^fn-9-1]: Anmerkung fett",
        "<P>k<Footnote>eins</Footnote></P><FnArea><Footnote>zwei</Footnote><Footnote/></FnArea>": "k eins\n\n## Fußnoten\n\n[^fn-1]: eins\n\n[^fn-2]: zwei",
        '<P><IMG SRC="b/1.png"/> <IMG SRC="http://o.example/x.gif" alt="A_b"/> <FILE SRC="/d.pdf" title="T"/><IMG/></P>':
            "!\\[Abbildung\\](https://src.example/s008/b/1.png) !\\[A\\\\\\_b\\](http://o.example/x.gif) \\[T\\](https://src.example/s008/d.pdf)",
        "<pre>  a\n b \n</pre>": "```text\n  a\n b\n```",
        "<Title>Kopf</Title><Ident/><TOC>weg</TOC><Revision><P>innen</P></Revision><kommentar>k. l</kommentar>lose": "**Kopf**\n\ninnen\n\nk. l\n\nlose",
        "<P># eins</P><P>1. Januar</P><P>&gt; x | y &lt; z *</P><P>| a</P>": "\\# eins\n\n1\\. Januar\n\n\\> x | y \\\\\\< z \\\\\\*\n\n\\| a",
        "<P> </P><DL/>": "",
    }
    assert dict(zip(cases, body(*cases))) == cases


def test_only_first_text_counts_and_notes_follow(body):
    xml = norm_xml("<P>eins</P>", notes="<fussnoten><Content><P>drei</P></Content></fussnoten><text><Content><P>zwei</P></Content></text>")
    early = xml.replace("<textdaten>", "<textdaten><fussnoten/>")
    assert body(xml, early) == ["eins\n\ndrei", "eins"]


def table(rows, extra=""):
    return f"<table>{extra}<tgroup><colspec colname='c1'/><colspec colname='c2'/><colspec colname='c3'/>{rows}</tgroup></table>"


def test_tables(body):
    plain = "<thead><row><entry>K</entry><entry>V</entry></row></thead><tbody><row><entry>a|b</entry><entry>c*</entry></row></tbody>"
    cases = {
        table(plain): "| K | V |\n| --- | --- |\n| a\\|b | c\\* |",
        table("<tbody><row><entry>x</entry></row></tbody><tfoot><row><entry>f</entry></row></tfoot>", "<Title>Name</Title>"): "**Name**\n\n|  |\n| --- |\n| x |\n| f |",
        table("<tbody><row><entry namest='c1' nameend='c3'>w</entry></row><row><entry morerows='1'>h</entry><entry>a &amp; 'b'</entry></row></tbody>"):
            '<table>\n<tbody>\n<tr>\n<td colspan="3">w</td>\n</tr>\n<tr>\n<td rowspan="2">h</td>\n<td>a &amp; &#039;b&#039;</td>\n</tr>\n</tbody>\n</table>',
        table("<thead><row><entry>1</entry></row></thead><tbody><row><entry>2</entry><entry>3_4</entry></row></tbody>"):
            "<table>\n<thead>\n<tr>\n<th>1</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>2</td>\n<td>3_4</td>\n</tr>\n</tbody>\n</table>",
        table("<tbody/>"): "",
        f"<P>vor {table(plain)} nach</P>": "vor\n\n| K | V |\n| --- | --- |\n| a\\|b | c\\* |\n\nnach",
        "<DL><DT>1.</DT><DD>" + table(plain) + "</DD></DL>": "- 1\\. KVa|bc\\\\\\*",
    }
    assert dict(zip(cases, body(*cases))) == cases


def test_cells_keep_their_places_under_open_row_spans():
    assert placed([[(1, 3, None), (2, 1, None), (1, 1, None)], [(1, 2, None), (1, 1, None)], [(2, 1, None)], [(1, 1, None)]]) == [[0, 1, 3], [1, 2], [2], [0]]
    assert placed([[(1, 1, 2), (1, 1, None)], [(1, 1, 0), (1, 1, 0)], [], [(3, 2, None)], [(1, 1, 1)]]) == [[2, 3], [0, 1], [], [0], [3]]


def test_cells_never_overlap():
    import random

    rng = random.Random(4)
    for _ in range(200):
        rows = [[(rng.randint(1, 3), rng.randint(1, 3), rng.choice([None, None, rng.randint(0, 5)])) for _ in range(rng.randint(0, 4))] for _ in range(5)]
        taken = set()
        for r, (row, at) in enumerate(zip(rows, placed(rows))):
            for (width, height, _), c in zip(row, at):
                own = {(r + y, c + x) for x in range(width) for y in range(height)}
                assert not own & taken
                taken |= own


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_containers_of_all_kinds(spark, tmp_path):
    folder = tmp_path / "in"
    good = law_xml(norm_xml("<P>ä &lt;b&gt; &#13;</P>"), "<other/>").encode()
    put(folder, "plain.xml", good)
    put(folder, "packed.zip", zipped(("readme.txt", b"x"), ("A.XML", good), ("b.xml", b"<dokumente/>")))
    put(folder, "latin.xml", b'<?xml version="1.0" encoding="ISO-8859-1"?>' + law_xml(norm_xml("<P>ä</P>")).encode("latin-1"))
    put(folder, "none.zip", zipped(("readme.txt", b"x")))
    put(folder, "text.txt", b"no law")
    put(folder, "cut.xml", good[:-20])
    put(folder, "empty.xml", b"<dokumente></dokumente>")
    put(folder, "broken.zip", b"PK\x03\x04rest")
    put(folder, "_hidden", b"x")
    rows = read_containers(spark, str(folder)).collect()
    norms = {(r.slug, r.position): ET.tostring(ET.fromstring(r.xml), encoding="unicode") for r in rows if r.error is None}
    whole = {s: [n for (slug, _), n in sorted(norms.items()) if slug == s] for s in ("plain", "packed", "latin")}
    assert whole["plain"] == whole["packed"] and len(whole["plain"]) == 2 and "ä &lt;b&gt; \r" in whole["plain"][1] and ">ä<" in whole["latin"][1]
    assert {r.document_id for r in rows if r.slug == "plain"} == {"LAW"}
    failed = {r.slug: r.error for r in laws.failed_containers(read_containers(spark, str(folder))).collect()}
    assert set(failed) == {"none", "text", "cut", "empty", "broken"} and failed["empty"] == "no norms"
    assert {r.slug for r in laws.fold_norms(read_containers(spark, str(folder)), BASE).collect()} == {"plain", "packed", "latin"}
    assert read_containers(spark, str(tmp_path / "nothing")).count() == 0


def test_written_containers_read_back(spark, tmp_path):
    rows = [(f"l{i}", law_xml(norm_xml(f"<P>{i}</P>"))) for i in range(20)] + [(None, "x"), ("y", None)]
    write_containers(spark.createDataFrame(rows, "slug string, xml string").repartition(4), str(tmp_path / "out"))
    got = read_containers(spark, str(tmp_path / "out"), partition_bytes=1000)
    assert got.rdd.getNumPartitions() > 3 and got.filter("position = 1").count() == 20 and got.filter("error is not null").count() == 0


def test_a_long_entry_needs_little_memory():
    norm = norm_xml("<P>" + "wort " * 2000 + "</P>").encode()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z, z.open("l.xml", "w") as out:
        out.write(b"<dokumente>")
        for _ in range(3000):  # 30 MB
            out.write(norm)
        out.write(b"</dokumente>")
    tracemalloc.start()
    packed.seek(0)
    assert sum(1 for _ in NormStream().norms(law_stream(packed))) == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def tables_of(spark, tmp_path, **laws_by_slug):
    folder = tmp_path / "laws"
    for slug, xml in laws_by_slug.items():
        put(folder, f"{slug}.xml", xml.encode())
    folded = laws.normalised(read_containers(spark, str(folder)), BASE)
    return [t.collect() for t in laws.law_tables(folded, BASE)]


def unit(code, label, title="", enbez=""):
    return f"<norm doknr='U'><metadaten>{enbez}<gliederungseinheit><gliederungskennzahl>{code}</gliederungskennzahl><gliederungsbez>{label}</gliederungsbez><gliederungstitel>{title}</gliederungstitel></gliederungseinheit></metadaten></norm>"


def titled(enbez, title="", content="<P>Text.</P>"):
    return norm_xml(content, f"<enbez>{enbez}</enbez><titel>{title}</titel>")


def test_law_records(spark, tmp_path):
    header = """<jurabk>ABC 2020</jurabk><amtabk>ABC</amtabk><ausfertigung-datum>2020-03-04</ausfertigung-datum>
        <fundstelle typ="sonst"><periodikum>X</periodikum><zitstelle>1</zitstelle></fundstelle><fundstelle typ="amtlich"><periodikum>BGBl I</periodikum></fundstelle>
        <fundstelle typ="amtlich"><periodikum>BGBl  I</periodikum><zitstelle>2020, 5</zitstelle></fundstelle><kurzue>Kurz<BR/>titel</kurzue><langue>Verordnung über <SUP>x</SUP></langue>
        <standangabe><standtyp>Stand</standtyp><standkommentar>alt</standkommentar></standangabe><standangabe><standtyp>Stand</standtyp><standkommentar>neu</standkommentar></standangabe>
        <standangabe><standtyp>Hinweis</standtyp><standkommentar>H1</standkommentar></standangabe><standangabe><standtyp>Hinweis</standtyp></standangabe><standangabe><standkommentar>S</standkommentar></standangabe>"""
    records, norms, _ = tables_of(spark, tmp_path, abc=law_xml(titled("§ 1"), header=header), none=law_xml(titled("§ 1"), header="<amtabk>XV</amtabk><ausfertigung-datum>2020-13-04</ausfertigung-datum>"))
    a, n = (next(r for r in records if r.slug == s) for s in ("abc", "none"))
    assert (a.document_id, a.kind, a.title, a.short_title, a.abbreviation, a.official_abbreviation, str(a.issued)) == ("LAW", "verordnung", "Verordnung über <sup>x</sup>", "Kurz titel", "ABC", "ABC", "2020-03-04")
    assert (a.promulgation, a.last_amending_act, a.pending_amendments, a.status_note, a.source_url) == ("BGBl I 2020, 5", "neu", ["H1"], "S", f"{BASE}/abc/")
    assert (n.kind, n.title, n.issued, n.promulgation, n.pending_amendments, n.last_amending_act) == ("verordnung", "none", None, None, [], None)


def test_norms_keys_and_structure(spark, tmp_path):
    law = law_xml(
        titled("Inhaltsübersicht"), unit("010", "Teil 1", "Anfang"), titled("§ 1", "(weggefallen)", ""), unit("010010010", "tief"), titled("§ 1"), titled("§ 1-2", "", "<P/>"), titled("§ 1"),
        unit("010020", "Kapitel 2"), unit("020", "Teil 2"), titled("Art 3"), unit("030", "Teil 3", "", "<enbez>Anlage 1</enbez>"), norm_xml("<P>frei</P>", ""),
    )
    _, norms, structure = tables_of(spark, tmp_path, x=law)
    assert [(r.norm_key, r.status, r.markdown) for r in sorted(norms, key=lambda r: r.place)] == [
        ("p1", "repealed", "(weggefallen)"), ("p1-2", "in_force", "Text."), ("p1-3", "in_force", "(kein Text)"), ("p1-4", "in_force", "Text."), ("art3", "in_force", "Text."),
        ("anl1", "in_force", "(kein Text)"), ("n-n1", "in_force", "frei"),
    ]
    nodes = {r.node: r for r in structure}
    tree = [(nodes[n].label, nodes[nodes[n].parent].label if nodes[n].parent is not None else None, nodes[n].norm_keys) for n in sorted(nodes)]
    assert tree == [("Teil 1", None, ["p1"]), ("tief", "Teil 1", ["p1-2", "p1-3", "p1-4"]), ("Kapitel 2", "Teil 1", []), ("Teil 2", None, ["art3"]), ("Teil 3", None, ["anl1", "n-n1"])]


def test_text_of_a_header(spark, tmp_path):
    notes = '<textdaten><fussnoten><Content><P>Seit 2020.</P></Content></fussnoten></textdaten></norm>'
    with_notes = law_xml(titled("Eingangsformel")).replace("</metadaten></norm>", "</metadaten>" + notes, 1)
    alone = law_xml(titled("§ 2")).replace("</metadaten></norm>", "</metadaten>" + notes, 1)
    _, norms, _ = tables_of(spark, tmp_path, a=with_notes, b=alone)
    assert {(r.slug, r.place, r.norm_key) for r in norms} == {("a", 0, "hinweise"), ("a", 1, "eingangsformel"), ("b", 0, "eingangsformel"), ("b", 1, "p2")}


def test_no_text_of_the_pages_is_lost(spark, sf_dir):
    """Against a plain reading of the same XML: the letters and digits of each norm, in order."""
    from lexstrata import plans
    from lexstrata.plans.laws import page_laws

    xml = {r.slug: r.xml for r in page_laws(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    got = {}
    for r in plans.QUERIES["law_markdown"](spark, sf_dir).collect():
        got.setdefault(r.slug, []).append(r)
    kept = lambda s: re.sub(r"[\W_]+", "", s)
    assert set(got) == set(xml)
    for slug, rows in got.items():
        root = ET.fromstring(xml[slug])
        expected = [kept("".join(e.itertext())) for e in (n.find("textdaten") for n in root) if e is not None and "".join(e.itertext()).strip()]
        plain = [kept(re.sub(r"<[^>]*>|\[\^[^]]*\]:?|## Fußnoten|\\", "", re.sub(r"(?s)<table>.*?</table>", lambda m: re.sub("<[^>]*>", "", m[0]), r.markdown))) for r in sorted(rows, key=lambda r: r.place)]
        assert [sorted(x) for x in expected] == [sorted(x) for x in plain]


def test_norms_fold_field_by_field():
    n = Norm(BASE).read("<norm><metadaten><enbez/><enbez>§ 2</enbez><sonst><titel>no</titel></sonst></metadaten><metadaten><titel>late</titel></metadaten></norm>")
    assert n.fields == {"enbez": ""} and n.unit is None and n.lines == [] and n.document_id is None


def test_functions_that_laws_stand_on(spark):
    from lexstrata.functions import text

    frame = spark.createDataFrame([("§§ 3 und 4a",), ("§§§ 2",), ("§7b",), ("Artikel12c",), ("ART. 5",), ("Anhang XIV",), ("anlage. 3b",), ("Schluss Ü",), ("  ",)], "a string")
    assert [r[0] for r in frame.select(text.norm_key(F.col("a"), F.lit("BJ9"))).collect()] == ["p3-4a", "p2", "p7b", "art12c", "art5", "anlxiv", "anl3b", "schluss-ue", "n-bj9"]


def test_folds_and_reads_stay_small(tmp_path):
    """A batch of norms is folded in pieces, and archives of a few megabytes are a task each."""
    import pandas as pd

    from lexstrata.operators.laws import in_pieces
    from lexstrata.sources.containers import ContainerReader

    batch = pd.DataFrame({"xml": ["a" * 60, "b" * 60, "c" * 500, "d", "e"]}, index=[7, 7, 3, 1, 0])
    pieces = [p["xml"].str[0].str.cat() for p in in_pieces(batch, "xml", 100)]
    assert "".join(pieces) == "abcde" and pieces == ["ab", "c", "de"] and [len(p) for p in in_pieces(batch, "xml")] == [5] and not list(in_pieces(batch[:0], "xml"))
    for i in range(5):
        (tmp_path / f"{i}.zip").write_bytes(bytes(3 << 20))
    parts = ContainerReader({"path": f"file:{tmp_path}"}).partitions()
    assert len(parts) == 5 and sorted(x for p in parts for x in p.paths) == [str(tmp_path / f"{i}.zip") for i in range(5)]
