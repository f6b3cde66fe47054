import random

import pytest

from recordloom.operators import csvrepair

TEXTS = {
    "semicolon": "ship;hull;port;flag\nHeron;steel;Cork;IE\nTern;wood;Vigo;ES\nSkua;steel;Brest;FR\n",
    "tab": "name\tage\tcity\tsalary\nAnn\t30\tRome\t$75,000\nBob\t25\tOslo\t£45,000\nEve\t35\tBonn\t€55,000\n",
    "repeated": "name,amount,date,amount,notes,\nAnn,1,2024-01-15,3,x,\nBob,4,2024-01-16,5,y,\nEve,6,2024-01-17,7,z,\n",
    "newlines": 'name,address,notes\nAnn,"1 High St\nTown","says ""hi"""\nBob,"2 Low St\nCity",ok\nEve,"3 Mid St\nPlace",fine\n',
    "widths": "name,age,city,country,zip\nAnn,30,Rome,IT,100\nBob,25,Oslo\nEve,35,Bonn,DE,300,x,y\nDan,40,Nice,FR,400\n",
    "preamble": "Report\nMade 2024\n\nBy: x\nname,amount,date,status\nAnn,10.5,2024-01-15,open\nBob,20.5,2024-01-16,closed\nEve,30.5,2024-01-17,open\nTotal,61.5,,\n",
    "odd": 'a,b\n1,"2\n3,4\n',
    "one_column": "name\nAnn\nBob\n",
}


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "document_id string, text string")
    return {k: [r.asDict() for r in df.collect()] for k, df in csvrepair.repaired(docs).items()}


def names(parts, doc):
    return [c["name"] for c in sorted((c for c in parts["columns"] if c["document_id"] == doc), key=lambda c: c["col_no"])]


def types(parts, doc):
    return [c["inferred_type"] for c in sorted((c for c in parts["columns"] if c["document_id"] == doc), key=lambda c: c["col_no"])]


def test_second_row_of_text_joins_the_header(parts):
    assert names(parts, "semicolon") == ["ship Heron", "hull steel", "port Cork", "flag IE"]


def test_types(parts):
    assert types(parts, "tab") == ["string", "integer", "string", "float"]
    assert types(parts, "preamble") == ["string", "float", "date", "string"]


def test_header_repair(parts):
    assert names(parts, "repeated") == ["name", "amount", "date", "amount_1", "notes", "column_6"]
    assert types(parts, "repeated") == ["string", "integer", "date", "integer", "string", "null"]


def test_quoted_cells(parts):
    values = {(c["row_no"], c["column_name"]): c["value"] for c in parts["cells"] if c["document_id"] == "newlines"}
    assert values[0, "address"] == "1 High St\nTown" and values[0, "notes"] == 'says "hi"'


def test_issues(parts):
    assert sorted(i["issue"] for i in parts["issues"] if i["document_id"] == "widths") == ["Row 2: padded from 3 to 5 columns", "Row 3: truncated from 7 to 5 columns"]


def test_preamble_and_trailing(parts):
    s = next(s for s in parts["summary"] if s["document_id"] == "preamble")
    assert (s["n_preamble"], s["header_rows"], s["n_rows"], s["n_trailing"]) == (3, 1, 3, 1)


def test_quarantine_and_single_column(parts):
    assert [q["document_id"] for q in parts["quarantine"]] == ["odd"]
    assert names(parts, "one_column")[0].startswith("name")


def test_decoding(spark):
    raw = [("bom", b"\xef\xbb\xbfname"), ("le", "﻿naïve".encode("utf-16-le")), ("latin", "caf\xe9".encode("latin-1")), ("utf", "é".encode())]
    out = {r.document_id: (r.encoding, r.text) for r in csvrepair.decoded(spark.createDataFrame(raw, "document_id string, content binary")).collect()}
    assert out == {"bom": ("utf-8-sig", "name"), "le": ("utf-16-le", "naïve"), "latin": ("latin-1", "café"), "utf": ("utf-8", "é")}


def all_rows(parts):
    return {k: sorted(map(str, (r.asDict() for r in df.collect()))) for k, df in parts.items()}


def untidy(n, seed=1):
    """One text with quoted line ends, doubled quotes, blank lines, and summary rows."""
    r, rows = random.Random(seed), ["made by hand", "", "name,amount,note"]
    for i in range(n):
        note = r.choice(["ok", '"two\nlines"', '"says ""hi"""', '"a\n\n\nb,"', "", '"x ""\n"" y"'])
        rows += [f"n{i},{i}.5,{note}"] + [""] * r.choice([0, 0, 1])
        if i % 17 == 0:
            rows[-1] += ",more"
    return "\n".join([*rows, "Total,1,", "total,2,", ""])


@pytest.mark.parametrize("by_parts", [False, True])
def test_chunks_do_not_matter(spark, by_parts, monkeypatch):
    docs = spark.createDataFrame([*TEXTS.items(), ("large", untidy(300)), ("blank", "\n\n"), ("empty", ""), ("odd again", untidy(20) + '"')], "document_id string, text string")
    whole = all_rows(csvrepair.repaired(docs))
    if by_parts:
        monkeypatch.setattr(csvrepair, "BROADCAST_DOCUMENTS", 0)
        monkeypatch.setattr(csvrepair, "PART_ROWS", 7)
    assert all_rows(csvrepair.repaired_lines(csvrepair.lines_of(docs, 3))) == whole
    assert len([x for x in whole["cells"] if "'large'" in x]) > 900 and [q for q in whole["quarantine"] if "odd again" in q]


def test_one_file_in_splits(spark, tmp_path):
    text = untidy(4000, 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\ufeff" + text)
    (tmp_path / "in" / "b.csv").write_bytes(untidy(9, 3).replace("\n", "\r\n").encode())
    keys = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        lines = csvrepair.lines_of_files(spark, f"file://{tmp_path}/in/*.csv")
        assert lines.where("document_id like '%a.csv'").select("chunk").distinct().count() > 4
        files = {k: df.withColumn("document_id", csvrepair.F.regexp_extract("document_id", "([ab])[.]csv$", 1)) for k, df in csvrepair.repaired_lines(lines).items()}
        out = all_rows(files)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    docs = spark.createDataFrame([("a", text), ("b", untidy(9, 3))], "document_id string, text string")
    assert out == all_rows(csvrepair.repaired(docs))
