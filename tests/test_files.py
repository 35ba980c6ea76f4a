"""Readers of folders, encodings, archives and Office files, on files made here."""

import io
import tarfile
import zipfile

import pytest

from heronry.sources import files

W = 'xmlns:w="urn:w"'


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return b.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / ".git").mkdir()
    (d / ".git" / "x.txt").write_text("no")
    (d / "a.txt").write_bytes("日本語の文\n".encode("cp932"))
    (d / "b.txt").write_bytes(b"\xef\xbb\xbfabc")
    (d / "c.txt").write_bytes("日本語の文です。\n".encode("euc_jp"))
    (d / "e.txt").write_bytes(b"")
    (d / "z.zip").write_bytes(zipped(in_dot_txt="hello", **{"..__out": "no"}))
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        i = tarfile.TarInfo("d/m.txt")
        i.size = 2
        t.addfile(i, io.BytesIO(b"hi"))
    (d / "t.zip").write_bytes(b.getvalue())
    (d / "bad.zip").write_bytes(b"nothing")
    (d / "s.xlsx").write_bytes(zipped(
        xl__workbook_dot_xml='<w xmlns:r="urn:r"><sheet name="S" r:id="1"/></w>', xl___rels__workbook_dot_xml_dot_rels='<r><R Id="1" Target="worksheets/a.xml"/></r>',
        xl__sharedStrings_dot_xml="<s><si><t>one</t></si></s>",
        xl__worksheets__a_dot_xml='<w><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>5</v></c><c r="A2" t="inlineStr"><is><t>in</t></is></c><c r="B2"/></w>',
    ))
    (d / "p.docx").write_bytes(zipped(word__document_dot_xml=f'<w:d {W}><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:strike/></w:rPr><w:t>old</w:t></w:r><w:r><w:t>new</w:t></w:r></w:p></w:d>'))
    (d / "q.pptx").write_bytes(zipped(ppt__slides__slide10_dot_xml="<a><p><t>ten</t></p></a>", ppt__slides__slide2_dot_xml="<a><p><t>two</t></p></a>"))
    return str(d)


def rows(df):
    return sorted((tuple(r)[0].rsplit("/", 1)[-1], *tuple(r)[1:]) for r in df.collect())


def read(spark, folder, pattern):
    return files.read_folder(spark, folder, pattern)


def test_texts(spark, folder):
    got = {r[0]: r for r in rows(files.texts(read(spark, folder, "*.txt")))}
    assert set(got) == {"a.txt", "b.txt", "c.txt"}
    assert got["a.txt"][1:5] == ("cp932", 0.0, "ok", "日本語の文\n")
    assert got["b.txt"][1] == "utf-8-sig" and got["b.txt"][4] == "abc"
    assert got["c.txt"][4] == "日本語の文です。\n"
    assert files.decode(b"") == ("utf-8", 0.0, "ok", "")


def test_garbled():
    assert files.decode(b"\x81 \x81 \x81 ")[2] == "undetermined"
    assert files.decode(b"a" * 400 + b"\n" + b"b\n" * 3 + b"\x81")[2] == "partial"


def test_members(spark, folder):
    got = rows(files.members(read(spark, folder, "*.zip")).drop("content"))
    assert got[1:] == [("t.zip", "d/m.txt", 2, None), ("z.zip", "in.txt", 5, None)]
    assert got[0][:3] == ("bad.zip", None, None) and got[0][3]


def test_office(spark, folder):
    assert rows(files.cells(read(spark, folder, "*.xlsx"))) == [("s.xlsx", "S", "A1", 1, 1, "one", None), ("s.xlsx", "S", "A2", 2, 1, "in", None), ("s.xlsx", "S", "AB1", 1, 28, "5", None)]
    assert rows(files.paragraphs(read(spark, folder, "*.docx"))) == [("p.docx", 1, "Heading2", "Head", None, None), ("p.docx", 2, None, "oldnew", "old", None)]
    assert rows(files.slides(read(spark, folder, "*.pptx"))) == [("q.pptx", 2, 1, "two", None), ("q.pptx", 10, 1, "ten", None)]
    assert rows(files.markdown(read(spark, folder, "*.{xlsx,docx,pptx}"))) == [
        ("p.docx", "## Head\n\noldnew", None), ("q.pptx", "## Slide 2\n\ntwo\n\n## Slide 10\n\nten", None), ("s.xlsx", "## S\n\n| one | 5 |\n| in |", None),
    ]


def test_too_large(spark, folder):
    got = files.texts(files.read_folder(spark, folder, "b.txt", largest=2)).first()
    assert got["text"] is None and "too large" in got["error"]
