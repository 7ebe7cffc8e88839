"""One channel for malformed records, quoted line breaks, encodings by file, headers by file."""

import pytest

from assaykit.sources import records as R
from assaykit.sources.readers import load

SCHEMA = "id long, city string, amount double"
BAD = ["_corrupt_record", "_corrupt_reason"]


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def kept(spark, path, **options):
    rows = load(spark, str(path), malformed="keep", **options).collect()
    sound = sorted((tuple(r)[:-3] for r in rows if r["_corrupt_record"] is None), key=str)
    return sound, sorted(tuple(r[c] for c in BAD) for r in rows if r["_corrupt_record"] is not None), {r["_corrupt_file"].rsplit("/", 1)[-1] for r in rows if r["_corrupt_file"]}


@pytest.mark.parametrize("ext, sep", [("csv", ","), ("tsv", "\t"), ("txt", "\t")])
def test_delimited(spark, tmp_path, ext, sep):
    path = tmp_path / f"in.{ext}"
    lines = [["id", "city", "amount"], ["1", "Oslo", "2.5"], ["2", "Rua do Paco", "67", "3"], ["3", "Bergen"], ["4", "NA", "many"], ["5", f'"a{sep}""b"""', "1"]]
    write(path, "\n".join(sep.join(x) for x in lines) + "\n")
    two, three, four = (sep.join(x) for x in lines[2:5])
    sound, bad, files = kept(spark, path, schema=SCHEMA)
    assert sound == [(1, "Oslo", 2.5), (5, f'a{sep}"b"', 1.0)] and files == {f"in.{ext}"}
    assert bad == sorted([(two, "4 cells, not 3"), (three, "2 cells, not 3"), (four, "value does not fit")])
    sound, bad, _ = kept(spark, path)
    assert sound == [("1", "Oslo", "2.5"), ("4", None, "many"), ("5", f'a{sep}"b"', "1")]
    assert bad == sorted([(two, "4 cells, not 3"), (three, "2 cells, not 3")])
    for schema in (SCHEMA, None):
        with pytest.raises(Exception, match="MALFORMED"):
            load(spark, str(path), schema=schema).collect()
    assert load(spark, str(path), malformed="keep").select("id").count() == 5  # pruning loses no fault


def test_json_lines_and_xml(spark, tmp_path):
    write(tmp_path / "in.jsonl", '{"id": 1, "city": "Oslo", "amount": 2.5}\n{"id": 2, "city":\n{"id": "x", "city": "Rom", "amount": 1.0}\n')
    sound, bad, files = kept(spark, tmp_path / "in.jsonl", schema=SCHEMA)
    assert sound == [(1, "Oslo", 2.5)] and files == {"in.jsonl"}
    assert bad == sorted([('{"id": 2, "city":', "no JSON"), ('{"id": "x", "city": "Rom", "amount": 1.0}', "value does not fit")])
    sound, bad, _ = kept(spark, tmp_path / "in.jsonl")
    assert len(sound) == 2 and bad == [('{"id": 2, "city":', "no JSON")]
    write(tmp_path / "in.xml", "<rows><row><id>1</id><city>Oslo</city><amount>2.5</amount></row><row><id>x</id><city>Rom</city><amount>1</amount></row></rows>")
    sound, bad, files = kept(spark, tmp_path / "in.xml", schema=SCHEMA)
    assert sound == [(1, "Oslo", 2.5)] and [b[1] for b in bad] == ["value does not fit"] and "<id>x</id>" in bad[0][0] and files == {"in.xml"}
    assert len(kept(spark, tmp_path / "in.xml")[0]) == 2
    for name in ("in.jsonl", "in.xml"):
        with pytest.raises(Exception, match="MALFORMED"):
            load(spark, str(tmp_path / name), schema=SCHEMA).collect()


def test_quoted_line_breaks(spark, tmp_path):
    write(tmp_path / "a.csv" / "part-1.csv", 'id,text\n1,"two\nlines, ""quoted"""\n2,"x\r\ny"\n3,plain\n')
    write(tmp_path / "a.csv" / "part-2.csv", 'id,text\n4,one line\n5,5 inch\n')
    expected = [("1", 'two\nlines, "quoted"'), ("2", "x\r\ny"), ("3", "plain"), ("4", "one line"), ("5", "5 inch")]
    assert kept(spark, tmp_path / "a.csv")[:2] == (expected, [])
    assert sorted(map(tuple, load(spark, str(tmp_path / "a.csv"), schema="id string, text string").collect())) == expected
    layouts = {r["file"].rsplit("/", 1)[-1]: r["whole"] for r in R.file_layouts(spark, str(tmp_path / "a.csv"), "UTF-8").collect()}
    assert layouts == {"part-1.csv": True, "part-2.csv": False}  # the other file stays splittable


def test_each_file_by_its_encoding_and_header(spark, tmp_path):
    folder = tmp_path / "b c[1].csv"
    write(folder / "utf8.csv", "id,text\n1,naïve 漢字 ελ\n")
    write(folder / "utf16.csv", 'id,text\n2,"漢字\nελ"\n', "utf-16")
    write(folder / "cp.csv", "id,text\n3,“café” €\n", "cp1252")
    write(folder / "latin.csv", "text,id\ncafé,4\n", "latin-1")
    write(folder / "more.csv", "id,text,note\n5,é,n\n6,short\n")
    path = str(folder).replace("[", "\\[").replace("]", "\\]")
    rows = load(spark, path, "csv", encoding=None, malformed="keep")
    assert rows.columns == ["id", "text", "note", *BAD, "_corrupt_file"] or set(rows.columns) == {"id", "text", "note", *BAD, "_corrupt_file"}
    got = {r["id"]: (r["text"], r["note"], r["_corrupt_reason"]) for r in rows.collect()}
    assert got == {"1": ("naïve 漢字 ελ", None, None), "2": ("漢字\nελ", None, None), "3": ("“café” €", None, None), "4": ("café", None, None),
                   "5": ("é", "n", None), "6": ("short", None, "2 cells, not 3")}


def test_separators_and_nothing(spark, tmp_path):
    write(tmp_path / "x.txt", "id;city\n1;Oslo\n")
    assert [tuple(r) for r in load(spark, str(tmp_path / "x.txt"), sep=";").collect()] == [("1", "Oslo")]
    assert [tuple(r) for r in load(spark, str(tmp_path / "x.txt")).collect()] == [("1", "Oslo")]
    write(tmp_path / "empty.csv", "")
    assert load(spark, str(tmp_path / "empty.csv"), schema=SCHEMA).collect() == []
    assert load(spark, str(tmp_path / "empty.csv"), malformed="keep").collect() == []
    with pytest.raises(ValueError, match="malformed"):
        load(spark, str(tmp_path / "x.txt"), malformed="drop")
