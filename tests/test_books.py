"""Archives, packages, contents, and whole books with the stand-in translator."""

import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from diglot.functions import decode
from diglot.operators import xml
from diglot.plans import book
from diglot.plans.client import CallFailed, Echo, English
from diglot.sources import epub, records

CONTAINER = "<?xml version='1.0'?><container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><!-- <rootfile full-path='no.opf'/> --><rootfile full-path='OEBPS/content.opf' media-type='application/oebps-package+xml'/></rootfiles></container>"
OPF = "<?xml version='1.0'?><package xmlns='http://www.idpf.org/2007/opf' xmlns:dc='" + xml.DC_SPACE + "'><metadata><dc:title>My Book</dc:title><dc:creator>Ann</dc:creator></metadata><manifest>{items}</manifest><spine toc='ncx'>{refs}</spine></package>"
NCX = "<?xml version='1.0'?><ncx xmlns='" + xml.NCX_SPACE + "'><navMap><navPoint id='a'><navLabel>Alpha</navLabel><content src='Text/alpha.xhtml'/><navPoint id='b'><navLabel><text>Beta</text></navLabel><content src='Text/beta.xhtml'/></navPoint><!-- --></navPoint><!-- --></navMap></ncx>"
PAGE = "<html><body><h1>{t}</h1><p>The {t} chapter has a paragraph of English text.</p></body></html>"


class Chinese(Echo):
    """A stand-in whose replies have more Chinese characters than letters."""

    prefix = "这是一段相当长的完整中文译文内容，足以盖过所有拉丁字母的数目："


def write(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)


def make_book(path, names=("alpha", "beta"), ncx=True):
    items = "".join(f"<item media-type='{xml.PAGE}' id='{n}' href='Text/{n}.xhtml'/>" for n in names) + (f"<item media-type='{xml.NCX}' id='ncx' href='toc.ncx'/>" if ncx else "")
    files = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF.format(items=items, refs="".join(f"<itemref idref='{n}'/>" for n in names))}
    files |= {f"OEBPS/Text/{n}.xhtml": PAGE.format(t=n.title()) for n in names} | ({"OEBPS/toc.ncx": NCX} if ncx else {})
    write(path, files | {"decoy.opf": "<package/>", "OEBPS/pad.bin": "x" * 3000})


def read(path):
    with zipfile.ZipFile(path) as z:
        return {n: z.read(n).decode("utf-8", "replace") for n in z.namelist()}, z.infolist()


@pytest.mark.parametrize(("raw", "want"), [
    ("中文".encode("utf-8-sig"), "中文"), ("中文".encode("utf-16"), "中文"), ("<p>中文</p>".encode("utf-16-le"), "<p>中文</p>"), ("<p>中文</p>".encode("utf-16-be"), "<p>中文</p>"),
    ('<meta charset="gb2312">镕'.encode("gbk"), '<meta charset="gb2312">镕'), ('<meta charset="latin-1">é“'.encode("cp1252"), '<meta charset="latin-1">é“'), ('<meta charset="latin-1">é中'.encode(), '<meta charset="latin-1">é中'),
    ('<?xml version="1.0" encoding="nonsense"?>é'.encode(), '<?xml version="1.0" encoding="nonsense"?>é'), (b"plain", "plain"), (b"\xff\xfeb\x00", "b"), (b"bad \xc3", "bad �"), (b"", ""), (None, ""),
])
def test_decode(spark, raw, want):
    assert decode.to_text(raw) == want
    df = spark.createDataFrame([(raw,)], "raw binary").select(decode.decoded("raw").alias("d"))
    assert df.first().d.text == want


def test_package_lookup():
    assert xml.package_path(["OEBPS/content.opf", "a.opf"], CONTAINER) == ("OEBPS/content.opf", None)
    assert xml.package_path(["z.opf", "a.opf"], CONTAINER)[0] == "a.opf" and xml.package_path(["z.opf"], None) == ("z.opf", "no usable container")
    assert xml.package_path(["x.html"], "broken <") == (None, None)
    p = xml.Package(OPF.format(items='<item id="a" href="x.html#f"/><item id="a" href="y.html"/><item id="n" media-type="' + xml.NCX + '" href="t.ncx"/>', refs='<itemref idref="a"/><itemref idref="gone"/>'))
    assert p.reading_order() == ["y.html"] and p.ncx() == "t.ncx" and (p.title, p.creator) == ("My Book", "Ann")


def test_new_documents_go_before_their_successor():
    text = OPF.format(items='<item id="c" href="Text/c.xhtml"/>', refs='<itemref idref="c"/>')
    order = [f"OEBPS/Text/{n}.xhtml" for n in "abcd"]
    new, warnings = xml.with_documents(text, [order[3], order[1], order[0]], "OEBPS/content.opf", order)
    assert xml.Package(new).reading_order() == ["Text/a.xhtml", "Text/b.xhtml", "Text/c.xhtml", "Text/d.xhtml"] and not warnings
    assert xml.with_documents(new, [order[0]], "OEBPS/content.opf", order)[0] == new


@pytest.mark.parametrize("empty", ["<manifest/><spine/>", "<manifest /><spine toc='x' />", "<manifest></manifest><spine></spine>"])
def test_empty_elements_are_opened(empty):
    new, _ = xml.with_documents(f"<package>{empty}</package>", ["a.html"], "content.opf", [])
    assert xml.Package(new).reading_order() == ["a.html"] and new.endswith("</package>")
    assert xml.with_documents("<package></package>", ["a.html"], "content.opf", [])[0] == "<package></package>"


def test_contents():
    fixed = xml.repaired_ncx(NCX, "My Book", "Ann")
    root = xml.tree(fixed)
    assert [p.get("playOrder") for p in xml.points(root)] == ["1", "2"] and 'content="2"' in fixed and "My Book" in fixed and "Ann" in fixed
    assert xml.repaired_ncx(fixed, "My Book", "Ann") == fixed and xml.repaired_ncx("junk", "", "") == "junk"
    page = xml.nav_page(fixed, "T")
    assert page.count("<ol>") == 2 and '<a href="Text/beta.xhtml">Beta</a>' in page
    assert 'properties="nav"' in xml.with_nav(OPF.format(items="", refs=""), "nav.xhtml")


def test_archives_round_trip(spark, tmp_path):
    make_book(tmp_path / "one.epub")
    members = epub.members(spark, str(tmp_path))
    assert members.count() == 8 and epub.members(spark, str(tmp_path), html="true").count() == 2
    epub.save(members, str(tmp_path / "out"))
    files, infos = read(tmp_path / "out" / "one.epub")
    assert infos[0].filename == "mimetype" and infos[0].compress_type == zipfile.ZIP_STORED and files == read(tmp_path / "one.epub")[0]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["one.epub"]


def test_shadowed_members(spark, tmp_path):
    with pytest.warns(UserWarning):
        with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
            z.writestr("a", "old")
            z.writestr("a", "new")
    assert [bytes(r.content) for r in epub.members(spark, str(tmp_path / "b.epub")).collect()] == [b"new"]
    log = spark.createDataFrame([("b", "a", 1, b"x"), ("b", "a", 2, b"y")], "book string, path string, seq long, content binary")
    assert bytes(epub.appended(log).first().content) == b"y"


def test_unsafe_names(spark):
    df = spark.createDataFrame([("b", "a:b"), ("b", "A.html"), ("b", "a.html"), ("b", "fine")], "book string, path string")
    assert sorted(tuple(r) for r in epub.unsafe_names(df).collect()) == [("b", "A.html", "case"), ("b", "a.html", "case"), ("b", "a:b", "characters")]


def test_cache_log(spark, tmp_path):
    lines = ['{"key":"a","response":"1"}', "", "{torn", '{"key":5,"response":"x"}', '{"key":"a","response":"2"}', '{"key":"b","response":"3"}', "[1]"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq int")
    assert sorted(tuple(r) for r in records.latest(records.cache_entries(df)).collect()) == [("a", "2"), ("b", "3")]
    assert records.needs_compaction(df, slack=3) and not records.needs_compaction(df, slack=4)
    records.append_cache(spark.createDataFrame([("k", "v"), ("e", "")], "key string, response string"), str(tmp_path / "log"))
    records.append_cache(spark.createDataFrame([("k", "w")], "key string, response string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    records.compact_cache(spark, str(tmp_path / "log"), str(tmp_path / "small"))
    assert spark.read.text(str(tmp_path / "small")).count() == 1


def test_states(spark):
    raw = spark.createDataFrame([(json.dumps({"base_sha1": "b", "src_sha1": "s", "done": ["x"], "attempts": {"y": 2}}),), ("[1]",), ("junk",)], "value string")
    found = records.states(raw).withColumn("book", F.lit("k"))
    prints = lambda b, s: spark.createDataFrame([("k", b, s)], "book string, base string, src string")
    assert found.count() == 1 and records.valid_states(found, prints("b", "s")).count() == 1
    assert records.valid_states(found, prints("b", "t")).count() == 0 and records.of_this_source(found, prints("x", "s")).count() == 1


def test_whole_book(spark, tmp_path):
    make_book(tmp_path / "in.epub", ("alpha", "beta", "gamma"))
    book.run(spark, str(tmp_path / "in.epub"), str(tmp_path / "out"), Chinese())
    both, infos = read(tmp_path / "out/bilingual/in.epub")
    assert infos[0].filename == "mimetype" and len({i.filename for i in infos}) == len(infos)
    for name in ("alpha", "beta", "gamma"):
        page = both[f"OEBPS/Text/{name}.xhtml"]
        assert f"<p>The {name.title()} chapter" in page and "<p>" + Chinese.prefix in page
    assert "OEBPS/nav.xhtml" in both and Chinese.prefix + "Alpha" in both["OEBPS/toc.ncx"] and 'properties="nav"' in both["OEBPS/content.opf"]
    alone, _ = read(tmp_path / "out/chinese/in-中文.epub")
    assert "chapter has a paragraph" not in alone["OEBPS/Text/beta.xhtml"] and Chinese.prefix in alone["OEBPS/Text/beta.xhtml"]


def test_resume_translates_only_what_is_missing(spark, tmp_path):
    make_book(tmp_path / "b.epub", ("a1", "a2", "a3"))
    done = book.translated(spark, str(tmp_path / "b.epub"), book.Calls(Echo()), only="a1.xhtml,a3.xhtml")
    epub.save(done.where("path <> 'OEBPS/Text/a2.xhtml'"), str(tmp_path / "have"))
    again = book.translated(spark, str(tmp_path / "b.epub"), book.Calls(Echo()), target=str(tmp_path / "have"))
    pages = {r.path: bytes(r.content).decode() for r in again.collect()}
    assert pages["OEBPS/Text/a1.xhtml"].count("译文：The") == 1 and pages["OEBPS/Text/a2.xhtml"].count("译文：The") == 1
    assert xml.Package(pages["OEBPS/content.opf"]).reading_order() == [f"Text/a{i}.xhtml" for i in (1, 2, 3)]


def test_english_replies_change_nothing(spark, tmp_path):
    make_book(tmp_path / "b.epub", ("one",))
    out = book.translated(spark, str(tmp_path / "b.epub"), book.Calls(English()))
    page = next(bytes(r.content).decode() for r in out.collect() if r.path.endswith("one.xhtml"))
    assert page == PAGE.format(t="One")
    assert io.StringIO(page).read() == page


class Counted(Chinese):
    """Notes each prompt in a folder; refuses those with a word."""

    def __init__(self, folder, refuse=None):
        self.folder, self.refuse = folder, refuse

    def chat(self, prompt, max_tokens=4000):
        (self.folder / uuid.uuid4().hex).write_text(prompt)
        if self.refuse and self.refuse in prompt:
            raise CallFailed("status 503", 503)
        return super().chat(prompt, max_tokens)


def prompts(folder):
    found = [p.read_text() for p in folder.iterdir()]
    [p.unlink() for p in folder.iterdir()]
    return found


def test_a_second_run_asks_only_for_what_failed(spark, tmp_path):
    make_book(tmp_path / "b.epub", ("alpha", "beta", "gamma"), ncx=False)
    (tmp_path / "calls").mkdir()
    args = spark, str(tmp_path / "b.epub"), str(tmp_path / "out")
    work = str(tmp_path / "work")
    with pytest.raises(CallFailed, match="1 calls failed"):
        book.run(*args, Counted(tmp_path / "calls", "The Beta chapter"), work=work, tasks=1)
    assert len(prompts(tmp_path / "calls")) == 3 and not (tmp_path / "out").exists()
    made = book.run(*args, Counted(tmp_path / "calls"), work=work)
    asked = prompts(tmp_path / "calls")
    assert sum("chapter" in p for p in asked) == 1 and any("The Beta chapter" in p for p in asked)
    assert "译" in read(tmp_path / "out/bilingual/b.epub")[0]["OEBPS/Text/alpha.xhtml"] and made["usage"].first().calls == 0
    state = json.loads(next((tmp_path / "work/state").glob("*.txt")).read_text())
    assert state["book"] == "b" and sorted(state["done"]) == [f"OEBPS/Text/{n}.xhtml" for n in ("alpha", "beta", "gamma")]
    book.run(*args, Counted(tmp_path / "calls"), work=work)
    assert prompts(tmp_path / "calls") == []
    book.translated(spark, str(tmp_path / "b.epub"), book.Calls(Counted(tmp_path / "calls")), work=work, again="beta.xhtml")
    assert all("Beta" in p for p in prompts(tmp_path / "calls"))


def test_futile_files_are_given_up_after_three_runs(spark, tmp_path):
    make_book(tmp_path / "b.epub", ("one",), ncx=False)
    work = str(tmp_path / "work")
    for n in (1, 2, 3):
        book.translated(spark, str(tmp_path / "b.epub"), book.Calls(English()), work=work)
        state = json.loads(next((tmp_path / "work/state").glob("*.txt")).read_text())
        assert (state["attempts"], state["done"]) == (({"OEBPS/Text/one.xhtml": n}, []) if n < 3 else ({}, ["OEBPS/Text/one.xhtml"]))


def test_first_blocks_go_by_job_in_each_book(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("p", "q"):
        make_book(tmp_path / "in" / f"{name}.epub", ("zeta", "alpha"), ncx=False)
    out = book.translated(spark, str(tmp_path / "in"), book.Calls(Echo()), most_blocks=1)
    pages = {(r.book, r.path): bytes(r.content).decode() for r in out.where("path like '%.xhtml'").collect()}
    assert all(("译文" in text) == (path == "OEBPS/Text/zeta.xhtml") for (_, path), text in pages.items()) and len(pages) == 4


def test_a_failed_call_in_order_keeps_the_other_files(spark, tmp_path):
    make_book(tmp_path / "b.epub", ("alpha", "beta"), ncx=False)
    (tmp_path / "calls").mkdir()
    with pytest.raises(CallFailed):
        book.translated(spark, str(tmp_path / "b.epub"), book.Calls(Counted(tmp_path / "calls", "The Beta chapter"), context=2), work=str(tmp_path / "work"))
    prompts(tmp_path / "calls")
    book.translated(spark, str(tmp_path / "b.epub"), book.Calls(Counted(tmp_path / "calls"), context=2), work=str(tmp_path / "work"))
    assert {"Alpha chapter" in p for p in prompts(tmp_path / "calls")} == {False}


def test_command_line(spark, tmp_path, capsys):
    from diglot.cli import main

    make_book(tmp_path / "b.epub", ("alpha",), ncx=False)
    assert main([str(tmp_path / "b.epub"), str(tmp_path / "out"), "--echo", "--test", "1"]) == 0
    assert "译文" in read(tmp_path / "out/bilingual/b.epub")[0]["OEBPS/Text/alpha.xhtml"] and "calls=" in capsys.readouterr().out
    assert not (tmp_path / "out/chinese").exists() and not (tmp_path / "out/.work/state").exists()
    assert main([str(tmp_path / "b.epub"), str(tmp_path / "titled"), "--echo", "--titles-only"]) == 0
    assert "译文" in read(tmp_path / "titled/b.epub")[0]["OEBPS/Text/alpha.xhtml"]
    assert main([str(tmp_path / "gone.epub"), str(tmp_path / "x"), "--echo"]) in (0, 1)
    with pytest.raises(SystemExit) as e:
        main(["--nonsense"])
    assert e.value.code == 2


def test_no_key_is_an_error(monkeypatch, capsys):
    from diglot.cli import main

    monkeypatch.delenv("DIGLOT_API_KEY", raising=False)
    assert main(["a", "b"]) == 1 and "DIGLOT_API_KEY" in capsys.readouterr().err


def test_archives_keep_no_directory_in_memory(tmp_path):
    """Many members, among them repeated and far ones; the standard module reads the same."""
    import tracemalloc

    at, n = str(tmp_path / "b.epub"), 70_000
    out = epub.NewArchive(at)
    out.add("mimetype", b"application/epub+zip", True)
    out.add("é/中.html", "内容".encode(), False)
    tracemalloc.start()
    for k in range(n):
        out.add(f"t/{k}.html", b"x" * (k % 50), False)
    out.add("t/7.html", b"again", False)
    out.close()
    read = epub.Reader({"path": at})
    batches, rows, seven = 0, 0, []
    for b in read.read(epub.Book(at)):
        batches, rows = batches + 1, rows + b.num_rows
        seven += [r for r in b.to_pylist() if r["path"] == "t/7.html"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n + 2 and batches > 3 and [(r["ord"], r["content"]) for r in seven] == [(n + 2, b"again")] and most < 16e6
    with zipfile.ZipFile(at) as z:
        assert len(z.namelist()) == n + 3 and z.read("é/中.html").decode() == "内容" and z.read("t/7.html") == b"again" and z.testzip() is None
        assert z.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_archives_of_others_are_read(tmp_path):
    at = str(tmp_path / "o.epub")
    with open(at, "wb") as f:
        f.write(b"before the archive")
    with zipfile.ZipFile(at, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.html", "one")
        z.comment = b"note"
    with epub.Archive(at) as z:
        assert [(x.filename, z.read(x)) for x in z.directory()] == [("a.html", b"one")]


def test_a_session_gets_small_batches(spark):
    from diglot.shipping import BATCH, ship

    key, _, smaller = BATCH
    spark.conf.unset(key)
    ship(spark)
    assert spark.conf.get(key) in (smaller, "8388608b")
