"""Readers, writers, archives and statistics files."""

import json
import random
from pathlib import Path

import numpy as np
import pytest

from quillon.plans import archive, codec
from quillon.sources import bytes_in, delimited, json_rows, portable, sas7bdat, spss, stata, stats, transport, writers
from quillon.sources.bytes_in import Refused
from quillon.sources.stats import Dataset, Variable


def put(folder, name, data):
    p = Path(folder) / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def cells(table):
    return [list(r)[2:] for r in table.rows.orderBy("file", "rid").collect()]


def test_records():
    parse = lambda t, **k: list(delimited.records(t, **k))
    assert parse('a,"b ""q"" ,\n",c\r\n\n1,"x"y"z",\r2') == [["a", 'b "q" ,\n', "c"], [""], ["1", 'xy"z"', ""], ["2"]]
    assert parse('a\n"open, and\nall the rest') == [["a"], ["open, and\nall the rest"]]
    assert parse("") == [] and parse("\n") == [[""]] and parse("a,") == [["a", ""]]
    assert parse('"a\tb"\tc', delimiter="\t", quoting=False) == [['"a', 'b"', "c"]]
    assert delimited.sniffed('a;b;"c,,,,"\n1,2,3,4') == ";" and delimited.sniffed("alone") == ","


def test_read_delimited(spark, tmp_path):
    t = delimited.read_delimited(spark, put(tmp_path, "t.csv", 'a,a,"b\nc"\n1,"x, y"\n\n3,4,5,,\n'))
    assert t.names == ["a", "a", "b\nc"] and cells(t) == [["1", "x, y", ""], ["", "", ""], ["3", "4", "5"]]
    with pytest.raises(Exception, match="row 1 has 3 cells"):
        cells(delimited.read_delimited(spark, put(tmp_path, "r.csv", "a,b\n1,2,3\n")))
    assert cells(delimited.read_delimited(spark, put(tmp_path, "h.csv", "a,b\n"))) == []
    assert delimited.read_delimited(spark, put(tmp_path, "e.csv", "")).names == []
    assert delimited.read_delimited(spark, put(tmp_path, "s.txt", "a;b\n1;2\n")).names == ["a", "b"]
    inches = delimited.read_delimited(spark, put(tmp_path, "q.csv", 'a,b\n"5" pipe,1\n"6" pipe,2\n7,3\n'))
    assert not inches.info["quoting"] and cells(inches) == [['"5" pipe', "1"], ['"6" pipe', "2"], ["7", "3"]]
    kept = delimited.read_delimited(spark, put(tmp_path, "b.csv", 'a,b\n"x, y"z,1\n"u, v",2\n"w, x",3\n'))
    assert kept.info["quoting"] and cells(kept) == [["x, yz", "1"], ["u, v", "2"], ["w, x", "3"]]


@pytest.mark.parametrize("codec_name,mark", [("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff")])
def test_marks(spark, tmp_path, codec_name, mark):
    t = delimited.read_delimited(spark, put(tmp_path, "m.csv", mark + "é,b\n1,ü\n".encode(codec_name)))
    assert t.names == ["é", "b"] and cells(t) == [["1", "ü"]]


def test_encodings_and_refusals(spark, tmp_path):
    assert cells(delimited.read_delimited(spark, put(tmp_path, "l.csv", "a\n\xe9\n".encode("latin-1")), encoding="latin-1")) == [["é"]]
    for raw, at in ((b"a\n\xe9\n", 2), (b"a\n\xc0\xaf", 2), (b"a\n\xed\xa0\x80", 2), (b"ab\xf5", 2)):
        with pytest.raises(Refused, match=f"at {at}"):
            bytes_in.decoded(raw)
    with pytest.raises(Refused, match="no known encoding"):
        bytes_in.decoded(b"a", "nonsense")
    assert bytes_in.refusal("x.xlsx", b"anything") and bytes_in.refusal("x.csv", b"PK\x03\x04junk") and bytes_in.refusal("x.csv", b"PAR1") and not bytes_in.refusal("x.csv", b"a\0b")
    with pytest.raises(Refused):
        delimited.read_delimited(spark, put(tmp_path, "z.csv", b"\x1f\x8b123"))
    assert [bytes_in.format_of(p) for p in ("A.TSV", "b.ndjson", "c.pq", "d.txt", "-")] == ["tsv", "jsonl", "parquet", "text", "csv"]


def test_json(spark, tmp_path):
    t = json_rows.read_json(spark, put(tmp_path, "a.json", '[{"b": 1.50, "a": null}, {"a": {"k": [1, NaN, "x\\n"]}, "c": true, "b": 1, "b": -0}]'))
    assert t.names == ["b", "a", "c"] and cells(t) == [["1.50", "", ""], ["-0", '{"k":[1,NaN,"x\\n"]}', "true"]]
    t = json_rows.read_json(spark, put(tmp_path, "c.json", '{"x": [1, 2], "y": ["a"], "z": []}'))
    assert t.names == ["x", "y", "z"] and cells(t) == [["1", "a", ""], ["2", "", ""]]
    t = json_rows.read_json(spark, put(tmp_path, "l.jsonl", '{"a": "\\ud83d\\ude00"}\n\n{"b": 2}\n'))
    assert cells(t) == [["😀", ""], ["", "2"]]
    for bad in ("[1]", "3", '{"a": 1}', "[" * 513 + "]" * 513, "[{]", '[{"a": ' + "1" * 79 + "}]"):
        with pytest.raises(Refused):
            list(json_rows.rows(bad, False))
    with pytest.raises(Refused, match="line 1"):
        list(json_rows.rows("[1]\n", True))


def test_lines_are_read_side_by_side(spark, tmp_path):
    rows = "".join(f'{i},"a, ""{i % 7}""",x{i % 3}\r\n' for i in range(3000))
    path = put(tmp_path, "big.csv", "\ufeffid,note,k\r\n" + rows)
    whole = delimited.read_delimited(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        split = delimited.read_delimited_lines(spark, path)
        assert split.rows.rdd.getNumPartitions() > 3
        assert split.names == whole.names == ["id", "note", "k"]
        key = lambda t: sorted((r.rid, r.c0, r.c1, r.c2) for r in t.rows.collect())
        assert key(split) == key(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for bad in ('a,b\n"x\ny",1\n', "a,b\n1,2\r3\n", b"a\n\xe9\n", "a,b\n1,2,3\n"):
        with pytest.raises(Exception):
            cells(delimited.read_delimited_lines(spark, put(tmp_path, "bad.csv", bad)))
    assert delimited.read_delimited_lines(spark, put(tmp_path, "none.csv", "")).names == []


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "150")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(split, whole):
    assert split is not None and split.names == whole.names and split.info == whole.info
    assert split.rows.rdd.getNumPartitions() > whole.rows.rdd.getNumPartitions()
    assert sorted(map(tuple, split.rows.collect())) == sorted(map(tuple, whole.rows.collect()))


def test_delimited_files_are_read_by_all_tasks(spark, tmp_path, small_splits):
    """Quotes that hold ends of lines, that are left open, that close early, any end of line, a mark or none."""
    rng = random.Random(5)
    header = ",".join(f"h{i}" for i in range(40)) + "\n"
    for kind, parts in (("some", ["a", "é", '"', '""', ",", "\n", "\r\n", "\r", "x y", ',"', '"\n', '",', "word " * 5]), ("few", ["plain words\n", "b,c", "\n", '"quoted\nlines, of ""text"""\n', '5" pipe,'])):
        folder = tmp_path / f"{kind}.csv"
        folder.mkdir()
        for i in range(5):
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(250)))
            put(folder, f"{i:02d}.csv", ("\ufeff" if i % 5 == 1 else "") + header + text)
        first = str(next(folder.glob("00.csv")))
        for quoting in (True, False, None):
            same(delimited._read_splits(spark, str(folder), first, None, None, quoting), delimited._read_whole(spark, str(folder), None, None, quoting))
    for text in ('a,b\n1,"open and\n' + "all the rest\n" * 30, 'a,b\n1,"open and\n' + "all\n" * 90 + "the rest", 'a,"b\nc"\n' + "1,2\n" * 90):
        path = put(tmp_path, "one.csv", text)
        same(delimited._read_splits(spark, path, path, None, None, None), delimited._read_whole(spark, path, None, None, None))
    with pytest.raises(Refused, match="byte 0xe9 at 129 is not utf-8"):
        delimited.read_delimited(spark, put(tmp_path, "bad.csv", b"\xef\xbb\xbfa\nb" + b"1\n" * 61 + b"x\xe9\n" + b"2\n" * 50))


def test_json_files_are_read_by_all_tasks(spark, tmp_path, small_splits):
    """Brackets and ends of line in strings, escapes, nesting, records longer than a split, any layout, a mark or none."""
    rng = random.Random(6)
    some = ["a", "é", "}", "{", "]", ",", "\n", '"', "\\", "😀", "}, {", '\\"}', "word " * 5]
    value = lambda: rng.choice([1, None, True, [], {}, [{"k": ["}"]}, "x"], {"d": {"e": "{"}}, "}" * rng.randrange(400), "".join(rng.choice(some) for _ in range(rng.randrange(30)))])
    for kind in ("json", "jsonl"):
        folder = tmp_path / f"all.{kind}"
        folder.mkdir()
        for i in range(6):
            records = [{f"k{rng.randrange(9)}": value() for _ in range(rng.randrange(5))} for _ in range((0, 1, 12, 12, 12, 30)[i])]
            if kind == "json":
                text = json.dumps(records, indent=(None, 1)[i % 2], ensure_ascii=i % 3 == 0) + " \n" * (i % 2)
            else:
                text = "".join(json.dumps(r, ensure_ascii=i % 3 == 0) + ("\n", "\r\n\n")[i % 2] for r in records)[: None if i % 2 else -1]
            put(folder, f"{i}.{kind}", ("\ufeff" if i in (1, 4) else "") + text)
        read = {"json": json_rows._read_arrays, "jsonl": json_rows._read_lines}[kind]
        same(read(spark, str(folder), None), json_rows._read_whole(spark, str(folder), kind == "jsonl", None))
    many = ",".join(f'{{"a": {i}}}' for i in range(60))
    for bad, said in ((f"[{many}, 1, {many}]", "record 61"), (f"[{many} {many}]", "record 61"), (f"[{many},]", "record 61"), (f"[{many}] x", "record 61"), (f'[{many},{{"a": 1.2.3}}]', "of record 61"), (f"[{many}", "not JSON"), (f"[{many}}}]", "not JSON")):
        with pytest.raises(Exception, match=said):
            cells(json_rows.read_json(spark, put(tmp_path, "bad.json", bad)))
    with pytest.raises(Refused, match="line 62 is no object"):
        json_rows.read_json(spark, put(tmp_path, "bad.jsonl", '{"a": 1}\n\n' + '{"a": 1}\n' * 59 + "1\n" + '{"a": 1}\n' * 9))
    assert json_rows.read_json(spark, put(tmp_path, "none.json", " [ ] ")).names == []


def test_writers(spark, tmp_path):
    source = put(tmp_path, "t.csv", 'id,note\n1,"a, ""b"""\n2,"l\nm"\n3,tab\there\n')
    t = writers.read_table(spark, source)
    writers.write_table(t, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes() == Path(source).read_bytes()
    for name in ("o.tsv", "o.psv", "o.json", "o.jsonl", "o.parquet"):
        writers.convert(spark, source, str(tmp_path / name))
        back = writers.read_table(spark, str(tmp_path / name))
        assert back.names == t.names and cells(back) == cells(t), name
    assert json.loads((tmp_path / "o.json").read_text())[1] == {"id": "2", "note": "l\nm"}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".o.") and p.is_dir()]
    twice = writers.read_table(spark, put(tmp_path, "d.csv", "a,a\n1,2\n"))
    for name in ("d.json", "d.jsonl", "d.parquet"):
        with pytest.raises(Refused, match="named 'a'"):
            writers.write_table(twice, str(tmp_path / name))
    none = writers.read_table(spark, put(tmp_path, "n.csv", "a,b\n"))
    writers.write_json(none, str(tmp_path / "n.json"))
    assert json.loads((tmp_path / "n.json").read_text()) == {"a": [], "b": []}
    with pytest.raises(Refused):
        writers.write_json_lines(none, str(tmp_path / "n.jsonl"))


ODD = ["", '"', "a,b", "x\ny", "\r", "\0", "-0", "-0.0", "007", "1.", ".5", "+1", str(2**62 - 1), str(2**62), "0." + "1" * 19, "\x01", "\x02", "12", "-12", "1.50", "é"]


def block(n, seed=0):
    rng = random.Random(seed)
    return [
        [rng.choice(ODD) for _ in range(n)], [str(i) for i in range(n)], [f"{i * 7 % 13}.{i % 100:02d}" if i % 40 else "" for i in range(n)], [str(i * 3) for i in range(n)], [str(i * 5 + 2) for i in range(n)],
        [f"POINT ({i * 7 % 13}.{i % 100:02d} {i})" for i in range(n)], [rng.choice("abc") for _ in range(n)], ["same"] * n, [str(2**62 - 1 - i % 2 * (2**63 - 2)) for i in range(n)],
    ]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 400])
def test_blocks_come_back(n):
    columns = block(n)
    names = list("abcdefg") + ["a", "é"]
    data = codec.encode_block(names, columns)
    assert codec.decode_block(data) == (names, columns)
    assert data == codec.encode_block(names, columns)


def test_long_texts_and_numbers_of_blocks():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(20_000)]
    cells = [" ".join(rng.choices(words, k=500)) for _ in range(1000)]
    block = codec.encode_block(["t"], [cells])
    assert codec.decode_block(block) == (["t"], [cells])
    raw = "".join(c + "\n" for c in cells).encode()
    assert len(raw) > codec.LONG_TEXT and block.endswith(codec.lzma.compress(raw, codec.lzma.FORMAT_RAW, filters=codec._LONG))
    for places in (0, 1, 5, 18):
        values = np.array([0, 7, -7, 10**18, 123456789, -(1 << 62), (1 << 62) - 1], np.int64)
        assert codec.all_written(values, places) == [codec.written(v, places) for v in values.tolist()]


def test_damaged_blocks_are_refused():
    data = codec.encode_block(list("abcdefghi"), block(120))
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(data)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        try:
            codec.decode_block(bytes(bad))
        except codec.Damaged:
            pass
    for bad in (b"", b"QLN1", data[:-1], data + b"x", b"XXXX" + data[4:]):
        with pytest.raises(codec.Damaged):
            codec.decode_block(bad)


def test_archives(spark, tmp_path):
    rows = "".join(f'{i},"region {i % 17}",{"ab"[i % 2]},{i / 4:.2f},"note, ""{i % 23}"""\n' for i in range(1200))
    t = writers.read_table(spark, put(tmp_path, "big.csv", "id,region,kind,value,note\n" + rows))
    path = str(tmp_path / "archive")
    archive.write_archive(t, path, rows_per_block=500)
    back = archive.read_archive(spark, path)
    assert back.names == t.names and cells(back) == cells(t)
    info = archive.info(spark, path)
    assert info["rows"] == 1200 and info["blocks"] == 3 and info["kinds"]["id"] == "num" and info["kinds"]["region"] == "dict"
    with pytest.raises(Exception, match="not of this archive"):
        cells(archive.decode(spark.read.parquet(path + "/blocks"), ["x"] * 5, 500))


def test_streamed_archive(spark, tmp_path):
    from quillon.streaming.blocks import archive_stream

    source = str(tmp_path / "in")
    spark.range(300).selectExpr("id", "concat('k', id % 5) AS k").repartition(3).write.parquet(source)
    archive_stream(spark.readStream.schema("id long, k string").parquet(source), str(tmp_path / "out"), str(tmp_path / "state"), 64).awaitTermination(120)
    back = archive.read_archive(spark, str(tmp_path / "out"))
    assert back.names == ["id", "k"] and archive.info(spark, str(tmp_path / "out"))["rows"] == 300
    with pytest.raises(codec.Damaged):
        archive_stream(spark.readStream.schema("id long, other string").parquet(source), str(tmp_path / "out"), str(tmp_path / "again"), 64)
    assert sorted((int(r.c0), r.c1) for r in back.rows.collect()) == [(i, f"k{i % 5}") for i in range(300)]


def data():
    return Dataset(
        "sas", [Variable("id"), Variable("sex", False, 8, "Sex of person", "", "sexes", [(8.0, 9.0)]), Variable("born", False, 8, "", "DATE9"), Variable("name", True, 11, "Näme"), Variable("x")],
        [(np.array([1.0, 2.0, 3.0]), [None] * 3), (np.array([1.0, 9.0, np.nan]), [None, None, "b"]), (np.array([0.0, 21310.0, np.nan]), [None, None, ""]), ["a", "bé", "longer text"], (np.array([-0.1, 1e10, 3.25]), [None] * 3)],
        "label here", {"sexes": {1.0: "male", 2.0: "female"}}, ["a note"],
    )


@pytest.mark.parametrize("kind,module", [("xpt", transport), ("dta", stata), ("sav", spss), ("por", portable)])
def test_statistics_files(spark, tmp_path, kind, module):
    own, lost = stats.translated(data(), kind)
    raw = module.written(own)
    back = module.parse(raw)
    assert stats.same(own, back) and back.label == ("" if kind == "por" else "label here")
    path = put(tmp_path, f"t.{kind}", raw)
    t = stats.read_stats_text(spark, path)
    text = cells(t)
    assert t.names == ["id", "sex", "born", "name", "x"] and text[1][2:] == ["2018-05-06", "bé", "10000000000"]
    assert text[1][1] == ("9" if kind in ("sav", "por") else ".a") and text[2][1] == ("" if kind in ("sav", "por") else ".b") and text[2][2] == ""
    rows, schema = stats.read_stats(spark, path)
    assert rows.count() == 3 and [v["name"] for v in schema["variables"]] == t.names
    assert json.loads(stats.read_schema(spark, path).first().schema)["rows"] == 3
    for other in ("xpt", "dta", "sav", "por"):
        out = stats.translate(spark, path, other).first()
        assert [c[0] for c in stats.rendered(stats.parser(other)(bytes(out.data)))] == [text[0][i] for i in range(5)]
    empty = Dataset(own.family, own.variables, [[] if v.text else (np.zeros(0), []) for v in own.variables])
    assert module.parse(module.written(empty)).rows == 0
    with pytest.raises(Refused):
        module.parse(b"something else")


def test_spss_bytecode_and_ibm_floats():
    import struct

    assert spss._unpacked(bytes([101, 253, 254, 255, 252, 0, 0, 0]) + b"abcdefgh", None, 100.0, "<") == struct.pack("<d", 1.0) + b"abcdefgh" + b" " * 8 + struct.pack("<d", spss.SYSMIS)
    x = np.array([0.0, 1.0, -1.0, 0.1, 123456.789, -1e-20, 2.0**200])
    assert np.allclose(transport.from_ibm(transport.to_ibm(x)), x, rtol=1e-15)
    assert int(transport.to_ibm(np.array([1.0]))[0]) == 0x4110000000000000


def test_commands(spark, tmp_path, capsys):
    from quillon.__main__ import main

    source = put(tmp_path, "t.csv", "id,k\n" + "".join(f"{i},{'ab'[i % 2]}\n" for i in range(300)))
    archived = str(tmp_path / "t.qln")
    assert main(["compress", source, "-o", archived, "--rows", "100"]) == 0
    assert main(["info", archived, "--json"]) == 0
    found = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert found["rows"] == 300 and found["blocks"] == 3
    assert main(["restore", archived, "-o", str(tmp_path / "back.csv")]) == 0
    assert (tmp_path / "back.csv").read_bytes() == Path(source).read_bytes()
    assert main(["stream-compress", source, "-o", str(tmp_path / "s.qln"), "--budget", "0.7"]) == 0
    assert main(["convert", source, str(tmp_path / "t.json")]) == 0
    assert main(["convert", put(tmp_path, "x.xlsx", b"PK\x03\x04junk"), str(tmp_path / "x.csv")]) == 1
    assert main(["restore", put(tmp_path, "bogus.qln", b"QLN1 not really"), "-o", str(tmp_path / "y.csv")]) == 1
    assert main(["nonsense"]) == 2 and main(["version"]) == 0
    dta = put(tmp_path, "d.dta", stata.written(stats.translated(data(), "dta")[0]))
    assert main(["convert", dta, str(tmp_path / "d.sav")]) == 0 and main(["convert", dta, str(tmp_path / "d.csv")]) == 0
    assert "lost: missing tags (2)" in capsys.readouterr().out


def test_base_30():
    for x in (0.0, 1.0, -1.0, 29.0, 30.0, 900.0, 0.5, 0.1, -123456.789, 1e10, 1e-7, 2.0**60):
        assert portable._Text(portable.base30(x)).number() == x, x


def sas_file(rows, packed=None, mark=b""):
    """A little-endian 64-bit file of a double `x` (format BEST, label "an x") and a string of 8, on one mixed page."""
    import struct

    word = lambda *x: struct.pack(f"<{len(x)}Q", *x)
    size, text = 16, b"\0\0" + mark.ljust(30) + b"xname".ljust(8) + b"BEST" + b"an x"
    row_size = bytearray(word(sas7bdat.ROW_SIZE) + bytes(8 * 100))
    for place, value in ((5, size), (6, len(rows)), (15, 0 if packed else len(rows))):
        row_size[8 * place : 8 * place + 8] = word(value)
    columns = word(sas7bdat.COLUMN_SIZE, 2) + bytes(8)
    strings = word(0xFFFFFFFFFFFFFFFD) + text
    names = word(0xFFFFFFFFFFFFFFFF) + struct.pack("<H6x", 8 + 16) + struct.pack("<HHHH", 0, 32, 1, 0) + struct.pack("<HHHH", 0, 33, 4, 0)
    attributes = word(0xFFFFFFFFFFFFFFFC) + struct.pack("<H6x", 8 + 32) + struct.pack("<QIHBB", 0, 8, 4, 1, 0) + struct.pack("<QIHBB", 8, 8, 4, 2, 0)
    first = word(0xFFFFFFFFFFFFFBFE) + bytes(38) + struct.pack("<HHHHHH", 0, 40, 4, 0, 44, 4)
    second = word(0xFFFFFFFFFFFFFBFE) + bytes(38) + bytes(12)
    pieces = [(bytes(x), 0) for x in (row_size, columns, strings, names, attributes, first, second)] + [(p, 4) for p in packed or []]
    page, end = bytearray(8192), 8192
    page[32:38] = struct.pack("<HHH", sas7bdat.META if packed else sas7bdat.MIXED, len(pieces) + (0 if packed else len(rows)), len(pieces))
    for k, (piece, kind) in enumerate(pieces):
        end -= len(piece)
        page[end : end + len(piece)] = piece
        page[40 + 24 * k : 64 + 24 * k] = struct.pack("<QQBB6x", end, len(piece), kind, 1 if kind else 0)
    start = 40 + 24 * len(pieces)
    if not packed:
        page[start : start + size * len(rows)] = b"".join(rows)
    header = bytearray(1024)
    header[:32] = sas7bdat.MAGIC
    header[32], header[35], header[37], header[70] = 0x33, 0x22, 1, 20
    header[196:204] = struct.pack("<II", 1024, 8192)
    header[204:212] = word(1)
    return bytes(header + page)


def test_sas_data_files(spark, tmp_path):
    import struct

    missing = struct.pack("<Q", 0xFFFF_FE00_0000_0000 & ~(0xFF << 40) | (255 - ord("B")) << 40)
    rows = [struct.pack("<d", 1.5) + "é".encode().ljust(8), missing + b"abcdefgh", struct.pack("<d", -2.0) + b" " * 8]
    path = put(tmp_path, "t.sas7bdat", sas_file(rows))
    t = stats.read_stats_text(spark, path)
    assert t.names == ["x", "name"] and cells(t) == [["1.5", "é"], [".b", "abcdefgh"], ["-2", ""]]
    assert (t.info["variables"][0]["shown"], t.info["variables"][0]["label"]) == ("BEST", "an x")
    runs = [bytes([0x8F]) + rows[0], bytes([0x8F]) + rows[1], bytes([0x87]) + rows[2][:8] + bytes([0xE6])]
    assert sas7bdat.parse(sas_file(rows, runs, b"SASYZCRL")).columns[1] == ["é", "abcdefgh", ""]
    copies = [b"\0\0" + r for r in rows[:2]] + [bytes([0, 0x80]) + rows[2][:8] + bytes([0x05, 32])]
    assert sas7bdat.parse(sas_file(rows, copies, b"SASYZCR2")).columns[1] == ["é", "abcdefgh", ""]
    assert sas7bdat.expand_copies(bytes([0x10, 0]) + b"abc" + bytes([0x30 | 0, 0]) + b"", 6) == b"abcabc"
    for bad in (b"no", sas_file(rows)[:3000]):
        with pytest.raises(Refused):
            sas7bdat.parse(bad)


@pytest.mark.parametrize("release,order", [(113, "<"), (114, "<"), (115, ">")])
def test_old_stata_files(release, order):
    import struct

    e, pad = order, lambda s, n: s.encode("cp1252").ljust(n, b"\0")
    width = 12 if release == 113 else 49
    raw = bytes([release, 2 if e == "<" else 1, 1, 0]) + struct.pack(e + "HI", 4, 3) + pad("a file", 81) + pad("", 18) + bytes([255, 252, 5, 251])
    raw += b"".join(pad(x, 33) for x in ("x", "n", "s", "b")) + bytes(10) + b"".join(pad(x, width) for x in ("%9.0g", "%td", "%5s", "%8.0g"))
    raw += b"".join(pad(x, 33) for x in ("", "", "", "yes")) + b"".join(pad(x, 81) for x in ("an x", "", "", "")) + struct.pack(e + "BI", 1, 4) + b"note" + struct.pack(e + "BI", 0, 0)
    missing = np.array([stata.DOUBLE_MISSING + 2 * stata.DOUBLE_STEP], np.int64).view(np.float64)[0]
    for x, n, s, b in ((1.5, 0, "é", 1), (missing, 21310, "abcde", 0), (-2.0, 32741, "", 102)):
        raw += struct.pack(e + "dh", x, n) + pad(s, 5) + struct.pack("b", b)
    words = b"no\0yes\0"
    body = struct.pack(e + "II", 2, len(words)) + struct.pack(e + "IIii", 0, 3, 0, 1) + words
    raw += struct.pack(e + "I", len(body)) + pad("yes", 33) + bytes(3) + body
    d = stata.parse(raw)
    assert stats.rendered(d) == [["1.5", ".b", "-2"], ["1960-01-01", "2018-05-06", ""], ["é", "abcde", ""], ["1", "0", ".a"]]
    assert d.sets == {"yes": {0.0: "no", 1.0: "yes"}} and d.variables[0].label == "an x" and d.label == "a file" and d.variables[3].labels == "yes"
    with pytest.raises(Refused):
        stata.parse(raw[:200])


@pytest.mark.parametrize("kind,module", [("xpt", transport), ("dta", stata), ("sav", spss), ("por", portable)])
def test_originals_come_back_byte_for_byte(spark, tmp_path, kind, module):
    from quillon.plans import originals

    raw = module.written(stats.translated(data(), kind)[0])
    (tmp_path / f"one.{kind}").write_bytes(raw)
    source, path = str(tmp_path / f"one.{kind}"), str(tmp_path / "kept")
    originals.write_originals(spark, source, path, 100)
    back = originals.read_originals(spark, path).collect()
    assert [bytes(r.content) for r in back] == [raw]
    widths = {r.width for r in spark.read.parquet(path + "/parts").select("width").collect()}
    assert (max(widths) > 0) == (kind == "dta")
    parts = spark.read.parquet(path + "/parts").where("part <> 1")
    parts.write.parquet(str(tmp_path / "torn" / "parts"))
    spark.read.parquet(path + "/plan").write.parquet(str(tmp_path / "torn" / "plan"))
    with pytest.raises(Exception, match="missing or damaged|not what it was"):
        originals.read_originals(spark, str(tmp_path / "torn")).collect()
    counts = stats.count_stats(spark, source).first()
    assert (counts.rows, counts.variables) == (3, 5)


def test_floats_and_signs_as_text():
    assert [stats.shortest(x) for x in (-0.0, 0.0, -3.0, 0.1, 1e15)] == ["-0", "0", "-3", "0.1", "1000000000000000.0"]
    import numpy as np

    for x in (0.1, 16777216.0, 3.14159274, 1e-7, 123456.789, -0.3):
        single = float(np.float32(x))
        text = stats.shortest_single(single)
        assert np.float32(float(text)) == np.float32(x) and len(text.replace("-", "").replace(".", "").lstrip("0")) <= 14
    assert stats.shortest_single(float(np.float32(0.1))) == "0.1" and stats.shortest_single(-0.0) == "-0"


def test_stata_119_and_wrong_bytes():
    raw = stata.written(stats.translated(data(), "dta")[0])
    newer = raw.replace(b"<release>118", b"<release>119")
    at = newer.index(b"<K>") + 3
    newer = newer[: at + 2] + b"\0\0" + newer[at + 2 :]  # the number of variables has four bytes
    at = newer.index(b"<map>") + 5
    import struct

    offsets = [x + 2 if i > 0 and x else x for i, x in enumerate(struct.unpack("<14Q", newer[at : at + 112]))]
    newer = newer[:at] + struct.pack("<14Q", *offsets) + newer[at + 112 :]
    assert stats.rendered(stata.parse(newer)) == stats.rendered(stata.parse(raw))
    assert stata._long_key(1, 2, 119, "<") == b"\1\0\0\2\0\0\0\0" and stata._long_key(1, 2, 118, ">") == b"\0\1\0\0\0\0\0\2"
    with pytest.raises(Exception, match="byte 0xff at"):
        stata.parse(raw.replace("bé".encode(), b"b\xff\xff"))


def test_long_streams_are_refused_before_they_fill_a_worker():
    import lzma

    raw = lzma.compress(b"a" * 50_000_000, lzma.FORMAT_RAW, filters=codec._TEXT)
    assert len(raw) < 100_000 and len(codec._plain(raw, codec._TEXT)) == 50_000_000
    for part, most in ((raw, 1_000_000), (raw[:-20], 1 << 30), (raw + b"x", 1 << 30)):
        with pytest.raises(codec.Damaged):
            codec._plain(part, codec._TEXT, most)


def test_writing_over_a_file(spark, tmp_path):
    path = str(tmp_path / "twice.csv")
    for rows in ("a,b\n1,2\n", "a,b\n3,4\n5,6\n"):
        t = writers.read_table(spark, put(tmp_path, "in.csv", rows))
        writers.write_delimited(t, path)
        with open(path) as f:
            assert f.read() == rows
