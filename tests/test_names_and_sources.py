import pytest
from pyspark.sql import functions as F

from factloom.functions.names import name_facts
from factloom.sources.files import read_items
from factloom.sources.signatures import png_size, sniff

NAMES = [
    ("IMG_20260919_101112.jpg", dict(name_date="2026-09-19", ext="jpg")), ("25-12-2020 party.png", dict(name_date="2020-12-25")), ("05-06-2020.png", dict(name_date=None)),
    ("Sep 19, 2026 notes.txt", dict(name_date="2026-09-19")), ("19 September 2026.txt", dict(name_date="2026-09-19")), ("1600000000123.jpg", dict(name_date="2020-09-13", name_date_confidence=0.45)),
    ("Bildschirmfoto 2024-01-02 um 10.11.12.png", dict(capture="screenshot", name_date="2024-01-02", looks_like="screenshot")), ("Screen Recording 3.mov", dict(capture="screen-recording")),
    ("._x", dict(litter=True, looks_like="os-litter")), ("Thumbs.db", dict(litter=True)), ("Untitled 3.txt", dict(generic_name=True)), ("d41d8cd98f00b204e9800998ecf8427e.png", dict(hash_name=True)),
    ("Love (1).mp3", dict(copy_marker="(1)")), ("Copy of a.txt", dict(copy_marker="copy of")), ("(1).txt", dict(copy_marker=None)), ("pic-300x200.jpg", dict(web_sized=True)), ("Report v2.doc", dict(version_marker="v2")),
    ("a%20b.txt", dict(url_encoded=True)), ("page_0042.tif", dict(sequence_prefix="page", sequence_number=42)), ("CV 2026.pdf", dict(sequence_prefix=None)),
    ("film.pt-BR.forced.srt", dict(subtitle_language="pt-br", subtitle_for="film")), ("film.en.txt", dict(subtitle_language=None)), ("plain", dict(ext="", looks_like=None)),
]


def test_name_detectors(spark):
    rows = {r.name: r for r in spark.createDataFrame([(n,) for n, _ in NAMES], "name string").select("name", *name_facts(F.col("name"))).collect()}
    for n, want in NAMES:
        for k, v in want.items():
            assert rows[n][k] == v, (n, k, rows[n][k])


PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000200000001008060000") + b"\0" * 8


@pytest.mark.parametrize("content, want", [
    (PNG, ("image", "png", 1.0)), (b"BM" + b"\0" * 20, ("image", "bmp", 0.85)), (b"\0\0\0\x18ftypheic" + b"\0" * 9, ("image", "heif", 1.0)), (b"\0\0\0\x18ftypisom", ("video", "mp4", 1.0)), (b"RIFF\0\0\0\0WAVEfmt ", ("audio", "wav", 1.0)),
    (b"\x1a\x45\xdf\xa3\x01\x00\x42\x82webm", ("video", "webm", 1.0)), (b"PK\x03\x04" + b"\0" * 26 + b"word/document.xml", ("document", "docx", 1.0)), (b"PK\x03\x04" + b"\0" * 20, ("archive", "zip", 1.0)), (b"\0" * 257 + b"ustar", ("archive", "tar", 1.0)), (b"fLaC", ("audio", "flac", 1.0)), (b"hello", None), (b"", None), (None, None),
])
def test_signatures(spark, content, want):
    r = spark.createDataFrame([(content,)], "c binary").select(sniff(F.col("c")).alias("s"), png_size(F.col("c")).alias("p")).first()
    assert (tuple(r.s) if r.s else None) == want
    assert (tuple(r.p) if r.p else None) == ((32, 16, True) if content == PNG else None)


def test_files_of_a_folder(spark, tmp_path):
    root = tmp_path / "watched"
    for path, content in (("a.png", PNG), ("b.jpg", PNG), ("sub/deep/c (1).txt", b"text"), ("x.app/inside.txt", b"no"), (".hidden/d.txt", b"no"), ("1/2/3/4/e.txt", b"no"), ("noext", b"?")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    got = {r.name: r for r in read_items(spark, str(root)).collect()}
    assert set(got) == {"a.png", "b.jpg", "c (1).txt", "noext"}
    assert (got["b.jpg"].format, got["b.jpg"].extension_lies, got["a.png"].extension_lies) == ("png", False, False)
    assert (got["c (1).txt"].kind, got["c (1).txt"].copy_marker, got["noext"].kind, got["a.png"].size_class) == ("document", "(1)", "unknown", "tiny")


def test_a_root_with_odd_characters_is_a_plain_prefix(spark, tmp_path):
    root = tmp_path / "main" / "in+(x)"
    for path in ("main/a.png", "1/2/3/4/e.txt", ".hidden/in+(x)/b.png"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(PNG)
    assert {r.name for r in read_items(spark, str(root)).collect()} == {"a.png"}
